"""Problem 4: values typed by hand mapped to a list of names, by a pigeonhole join in built-in functions only.

Values and names are folded (mis-decoded text, accents, look-alike letters, case, punctuation, spacing, short forms).
Each name is cut into k + 1 segments with one free character between neighbours, so that k slips leave a segment whole;
values that are no name's exact fold join it on the segment's text at the places it may have, and levenshtein, with
one or two neighbour swaps tried beside it, verifies. Names under eight letters, whose segments would be single letters
that many values have, meet by what is left of them without two letters. An anti-join reports what means no name. The
work is done once per distinct value. Short forms of words and words around a name are parameters; the lists given here
are English ones.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import salted_join, spread, stage

SLIPS = 2
#: Names of fewer letters are not cut.
SHORT = 8
#: Common short forms of words in place names.
SHORT_FORMS = {
    "mt": "mount", "mnt": "mount", "st": "saint", "ste": "saint", "ft": "fort", "frt": "fort", "pt": "port", "prt": "port",
    "n": "north", "no": "north", "nth": "north", "nrth": "north", "s": "south", "so": "south", "sth": "south", "e": "east", "w": "west",
    "lk": "lake", "hts": "heights", "hgts": "heights", "hghts": "heights", "ht": "heights", "jct": "junction", "jctn": "junction", "jn": "junction", "jnc": "junction", "junc": "junction",
    "bch": "beach", "bea": "beach", "spg": "springs", "spgs": "springs", "sprg": "springs", "sprgs": "springs", "spr": "springs", "spngs": "springs",
    "vlg": "village", "vill": "village", "vil": "village", "vlge": "village", "vly": "valley", "val": "valley", "vlly": "valley",
}
#: Words around a place name that do not change the place.
AROUND = ["city", "of", "town", "the", "downtown", "uptown", "midtown", "central", "centre", "center", "greater", "metro", "metropolitan", "area", "municipality", "in", "near"]
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕԁһӏвкмнтгѵԛԝαεικνορτυχβηγℓı", "aceopxyijsdhlbkmhtrvqwaeikvoptuxbhyli"))


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks and full-width forms and their base letters, by rule."""
    table = dict(LOOKALIKES) | {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ð": "d"}
    for cp in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(cp).lower()) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum():
            table.setdefault(chr(cp).lower(), base[0])
    return "".join(table), "".join(table.values())


def _misread(letters: str) -> str:
    """A class of the second characters that UTF-8 letters show when read in a one-byte encoding."""
    out = set()
    for x in letters:
        second = x.encode()[1:2]
        out.add(second.decode("latin-1"))
        try:
            out.add(second.decode("cp1252"))
        except UnicodeDecodeError:
            pass
    return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in sorted(out)) + "]"


_FOUND, _BASE = _fold_table()
_MISREAD = {"a": "àáâãäåÀÁÂÃÄÅ", "c": "çÇ", "e": "èéêëÈÉÊË", "i": "ìíîïÌÍÎÏ", "n": "ñÑ", "o": "òóôõöøÒÓÔÕÖØ", "u": "ùúûüÙÚÛÜ", "y": "ýÿÝ", "ss": "ß"}


def folded(c: Column) -> Column:
    """Words of plain lower-case letters and digits with single spaces between; "" if there are none."""
    t = F.regexp_replace(F.regexp_replace(c, "[Ãã](?:ƒ|\\x{83})[Ââ]?", "Ã"), "[Ââ](?=[\\x{80}-\\x{bf}])", "")
    for base, letters in _MISREAD.items():
        t = F.regexp_replace(t, f"[Ãã]{_misread(letters)}", base)
    t = F.lower(F.regexp_replace(t, "[\\p{M}\\x{ad}\\x{200b}-\\x{200f}\\x{2060}\\x{feff}'’`´]", ""))
    t = F.translate(t, _FOUND, _BASE)
    for many, few in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        t = F.replace(t, F.lit(many), F.lit(few))
    return F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))


def _words(c: Column, short_forms: dict[str, str]) -> Column:
    """The folded words, short forms spelled out."""
    full = F.create_map(*[F.lit(x) for pair in short_forms.items() for x in pair]) if short_forms else F.create_map().cast("map<string,string>")
    return F.transform(F.split(folded(c), " "), lambda w: F.coalesce(F.try_element_at(full, w), w))


def _joined(words: Column) -> Column:
    return F.array_join(words, "")


def _turns(words: Column, longest: Column) -> Column:
    """The words from each start, end joined to beginning: other orders of a name of two parts; none if they are too long for any name."""
    n = F.size(words)
    fits = F.length(_joined(words)) <= longest + SLIPS
    return F.when(~fits, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _joined(F.concat(F.slice(words, i, n), F.slice(words, F.lit(1), i - 1)))))


def _forms(c: Column, regions: Column, longest: Column, short_forms: dict[str, str], around: list[str]) -> Column:
    """Spaceless spellings to look for: all words, then without region codes, then also without the words around."""
    words = _words(c, short_forms)
    placed = F.filter(words, lambda w: ~F.array_contains(regions, w))
    bare = F.filter(placed, lambda w: ~w.isin(around))
    return F.filter(F.array_distinct(F.concat(_turns(words, longest), _turns(placed, longest), _turns(bare, longest))), lambda f: f != "")


def _segments(n: Column) -> Column:
    """(seg, at, len) of the three segments of a name of n letters, places from 1, one free letter between them."""
    a = F.floor(n / 3).cast("int")
    b = F.greatest(F.floor((n - 2 - a + 1) / 2).cast("int"), F.lit(0))
    one = lambda k, at, size: F.struct(F.lit(k).alias("seg"), at.alias("at"), F.greatest(size, F.lit(0)).alias("len"))
    return F.array(one(0, F.lit(1), a), one(1, a + 2, b), one(2, a + b + 3, n - a - b - 2))


def _shortened(c: Column) -> Column:
    """A text and what is left of it without one or two letters; texts two slips apart share one of these."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = without(c)
    return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, without))))


def _swapped(c: Column) -> Column:
    """c with each two neighbours swapped, once each."""
    n = F.length(c)
    one = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, n))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), one)).otherwise(F.array().cast("array<string>"))


def slips(a: Column, b: Column) -> Column:
    """0, 1 or 2 wrong, missing, extra or swapped letters between two texts; null beyond."""
    lev = F.levenshtein(a, b, 4)
    near = lambda x, y: F.exists(_swapped(x), lambda s: F.levenshtein(s, y, 1) >= 0)
    swap = lambda: F.array_contains(_swapped(a), b)
    two = near(a, b) | near(b, a) | F.arrays_overlap(_swapped(a), _swapped(b))
    return F.when(lev < 0, None).when(lev <= 1, lev).when((lev == 2) & swap(), 1).when(lev == 2, 2).when(two, 2)


def name_matches(values: DataFrame, names: DataFrame, value: str, name: str, name_id: str, region: str | None = None, short_forms: dict[str, str] = SHORT_FORMS, around: list[str] = AROUND) -> DataFrame:
    """value, name_id, slips: the nearest name of each distinct value that means one, ties to the smaller id.

    Null and blank values and names are no cases. names is a reference list: its region codes are gathered as one array.
    """
    v = values.select(F.col(value).alias("value")).where(folded(F.col(value)) != "").distinct()
    ref = names.select(F.col(name_id).alias("name_id"), _joined(_words(F.col(name), short_forms)).alias("full")).where(F.col("full") != "")
    regions = names.agg(F.collect_set(F.lower(region))).scalar() if region else F.array().cast("array<string>")
    known = v.withColumn("regions", regions).withColumn("longest", ref.agg(F.coalesce(F.max(F.length("full")), F.lit(0))).scalar())
    # Few bytes but long work: in as many tasks as there are cores, and once for the exact and the near matches.
    forms = stage(spread(known, "value").select("value", F.explode(_forms(F.col("value"), F.col("regions"), F.col("longest"), short_forms, around)).alias("form")))
    exact = forms.join(ref, forms["form"] == ref["full"]).select("value", "name_id", F.lit(0).alias("slips"))
    rest = forms.join(exact.select("value").distinct(), "value", "left_anti")
    long_names = ref.where(F.length("full") >= SHORT)
    cut = long_names.select("name_id", "full", F.length("full").alias("n"), F.explode(_segments(F.length("full"))).alias("s")).select("name_id", "full", "n", "s.seg", F.substring(F.col("full"), F.col("s.at"), F.col("s.len")).alias("part"))
    m = F.length("form")
    sized = rest.where(m >= SHORT - SLIPS).select("value", "form", F.explode(F.sequence(F.greatest(m - SLIPS, F.lit(SHORT)), m + SLIPS)).alias("n"))
    placed = sized.select("value", "form", "n", F.explode(_segments(F.col("n"))).alias("s"), F.sequence(F.lit(-SLIPS), F.lit(SLIPS)).alias("by"))
    parts = F.array_distinct(F.transform("by", lambda k: F.when(F.col("s.at") + k >= 1, F.substring(F.col("form"), F.col("s.at") + k, F.col("s.len")))))
    probes = placed.select("value", "form", "n", "s.seg", "s.len", F.explode(parts).alias("part")).where(F.length("part") == F.col("len"))
    met = probes.join(cut, ["n", "seg", "part"]).select("value", "form", "name_id", "full")
    rests = ref.where(F.length("full") < SHORT).select("name_id", "full", F.explode(_shortened(F.col("full"))).alias("left"))
    met = met.unionByName(rest.where(m < SHORT + SLIPS).select("value", "form", F.explode(_shortened(F.col("form"))).alias("left")).join(rests, "left").select("value", "form", "name_id", "full"))
    near = spread(met, "value", "form", "name_id", "full").distinct()
    fuzzy = near.withColumn("slips", slips(F.col("form"), F.col("full"))).where(F.col("slips").isNotNull())
    every = exact.unionByName(fuzzy.select("value", "name_id", "slips"))
    best = every.groupBy("value").agg(F.min(F.struct("slips", "name_id")).alias("m"))
    return best.select("value", "m.name_id", "m.slips")


def map_to_names(records: DataFrame, record_id: str, value: str, names: DataFrame, name: str, name_id: str, region: str | None = None, **lists) -> DataFrame:
    """record_id, value, name_id, slips for records whose value is neither null nor blank; name_id is -1 for no name.

    Repeated records stay; a value of marks only is no name; an empty list of names gives -1 for all.
    """
    rows = records.select(F.col(record_id).alias("record_id"), F.col(value).alias("value")).where(F.regexp_replace("value", "[\\s\\x{a0}]+", "") != "")
    found = stage(name_matches(rows, names, "value", name, name_id, region, **lists))
    matched = salted_join(rows, found, ["value"])
    unmatched = rows.join(found.select("value"), "value", "left_anti").select("record_id", "value", F.lit(-1).cast("long").alias("name_id"), F.lit(None).cast("int").alias("slips"))
    return matched.select("record_id", "value", F.col("name_id").cast("long"), F.col("slips").cast("int")).unionByName(unmatched)

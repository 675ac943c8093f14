"""Problem 5: several values packed in one text, one row per value with its position.

A text's skeleton is what is left when its ordinary characters and its quoted parts are masked out: the notation (list
literal or fields), whether it has quotes, and which delimiters stand outside of quotes. There are at most 2 ** 12
skeletons whatever the table's size, so the splitting rules resolved for the distinct ones are safe to broadcast. A
rule holds the pattern that cuts at its skeleton's own delimiters and at no others; each text is cut by its rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = ",;|、，\n\r\t"
_CLASS = ",;|、，\\n\\r\\t"
_BLANK = "\\s\\u00a0\\u3000\\ufeff"
#: A quoted field (a doubled quote is a quote) up to a delimiter of the class {0} or the text's end.
_QUOTED = '{1}"[^"]*+(?:""[^"]*+)*+"{1}(?=[{0}]|$)'
#: A string of a list literal in either quote, with backslash escapes, or a bare member.
_MEMBER = "[uUbB]?\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\"|[uUbB]?'[^'\\\\]*+(?:\\\\.[^'\\\\]*+)*+'|[^,\\s][^,]*+"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c\u00a0\u3000\ufeff"))


def _parting(blanks: bool) -> tuple[str, str]:
    """The class of all delimiters of a field, and what may stand between a quote and a delimiter."""
    return (_CLASS + _BLANK, "") if blanks else (_CLASS, f"[{_BLANK}&&[^{_CLASS}]]*+")


def skeleton(text: Column, blanks: bool = False) -> Column:
    """`[` for a list literal, else the sorted set of the delimiters outside of quotes, with `"` if the text has quotes; null for null.

    With blanks, white space parts values; it is one delimiter, a space.
    """
    t = _strip(text)
    inside, _ = _parting(blanks)
    bare = F.regexp_replace(t, f"{_QUOTED.format(*_parting(blanks))}|[^{inside}]++", "")
    bare = F.regexp_replace(bare, f"[{_BLANK}]++", " ") if blanks else bare
    outside = F.array_join(F.array_sort(F.array_distinct(F.split(bare, ""))), "")
    # Without quotes what stands outside of them is what the text contains; no masking is needed to tell.
    marks = sorted(x for x in DELIMITERS if not (blanks and x.isspace()))
    held = F.concat(*([F.when(t.rlike(f"[{_BLANK}]"), " ").otherwise("")] if blanks else []), *[F.when(F.contains(t, F.lit(x)), x).otherwise("") for x in marks])
    return F.when(t.startswith("["), "[").when(F.contains(t, F.lit('"')), F.concat(outside, F.lit('"'))).otherwise(held)


def splitting_rules(skeletons: DataFrame, blanks: bool = False) -> DataFrame:
    """skeleton, notation, pattern: `members` for a list literal, else `fields`; the pattern matches one value of the notation, blank ones too."""
    s = F.col("skeleton")
    cuts = F.replace(s, F.lit('"'), F.lit(""))
    inside = F.replace(cuts, F.lit(" "), F.lit(_BLANK))
    run = F.concat(F.lit("[^"), inside, F.lit("]++"))
    head, tail = _QUOTED.format("\0", _parting(blanks)[1]).split("\0")
    quoted = F.concat(F.lit(head), inside, F.lit(tail + "|"))
    fields = F.when(cuts == "", "[\\s\\S]++").when(F.contains(s, F.lit('"')), F.concat(quoted, run)).otherwise(run)
    listed = s == "["
    return skeletons.select("skeleton", F.when(listed, "members").otherwise("fields").alias("notation"), F.when(listed, F.lit(_MEMBER)).otherwise(fields).alias("pattern"))


def _unescaped(token: Column) -> Column:
    """A member without its quotes and escapes."""
    bare = F.regexp_replace(token, "^[uUbB]?[\"']|[\"']$", "")
    plain = F.regexp_replace(bare, "\\\\(.)", "$1")
    as_json = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(bare, "\\\\'", "'"), '(?<!\\\\)"', '\\\\"'), F.lit('"]'))
    read = F.coalesce(F.get(F.from_json(as_json, "array<string>"), F.lit(0)), plain)
    return F.when(~token.rlike("^[uUbB]?[\"'][\\s\\S]*[\"']$"), token).when(F.contains(bare, F.lit("\\")), read).otherwise(bare)


def _unquoted(t: Column) -> Column:
    """A field without its quotes; t has no blanks around."""
    quoted = t.startswith('"') & t.endswith('"') & (F.length(t) > 1)
    return F.when(quoted, _strip(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))).otherwise(t)


def unpack(df: DataFrame, record_id: str, packed: str, nothing: tuple[str, ...] = (), blanks: bool = False) -> DataFrame:
    """record_id, pos, item: the values of the text column `packed`, in order, pos from 0.

    Null, blank and the whole texts in `nothing` hold no values; blank values give no row and take no position;
    repeated values, repeated rows and rows with a null record id stay. blanks says that white space parts values too,
    for fields whose values have none. Other columns of df are not read.
    """
    rows = df.select(F.col(record_id).alias("record_id"), _strip(F.col(packed)).alias("text"))
    rows = rows.where(F.col("text") != "")
    if nothing:
        rows = rows.where(~F.col("text").isin(*nothing))
    rows = rows.withColumn("skeleton", skeleton(F.col("text"), blanks))
    rules = splitting_rules(rows.select("skeleton").distinct(), blanks)
    ruled = rows.join(F.broadcast(rules), "skeleton")
    listed = F.col("notation") == "members"
    body = F.when(listed, F.regexp_replace(F.col("text"), "^\\[|\\]$", "")).otherwise(F.col("text"))
    tokens = F.regexp_extract_all(body, F.col("pattern"), F.lit(0))
    members = F.transform(tokens, lambda t: _strip(_unescaped(_strip(t))))
    bare = tokens if blanks else F.transform(tokens, _strip)  # with blanks no token has any outside of quotes
    fields = F.when(F.contains("text", F.lit('"')), F.transform(bare, _unquoted)).otherwise(bare)
    kept = F.filter(F.when(listed, members).otherwise(fields), lambda x: x != "")
    return ruled.select("record_id", F.posexplode(kept).alias("pos", "item"))

"""Problem 10: per-document text statistics, and which texts are not natural prose.

Each text is cut into blocks at blank lines and code fences. Thresholds on a block's statistics are noisy labelling
functions that vote prose, not prose, or nothing. Expectation-maximization over the counts of the vote patterns of all
blocks, of which there are at most 3 ** len(VOTES), learns how each function votes on either class from their
agreements alone, and gives each pattern's posterior. A document's share of prose is the posterior mean over its
characters. What is not prose is told apart in the same way into lists, tables, code and junk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import on_all_cores, stage

#: Common function words of some languages.
COMMON = sorted(set("""
a about after all also although am an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its just
me more most my no not of off on once one only or other our out over she should so some such than that the their them then there these they this to too until up was we were
what when where which while who why will with would you your
aber als am an auch auf aus bei bis das dass dem den der des deshalb die doch durch ein eine einem einen einer es für habe haben hat ich im in ist ja kann man mein mit nach
nicht noch nur oder ohne sehr sich sie sind so und uns viel von vor war was weil wenn wie wieder wird wurde zu zum zur
à après au aussi avant avec ce ces cette comme dans de des depuis donc du elle en est et être il ils j je l la le les leur mais même n ne nous on ont ou où par pas plus pour
qu quand que qui s sa sans se si son sont sur tout très tu un une vous y
al algo con como cuando de del desde donde el ella en era es esta este fue ha hay la las le lo los más me mi muy nada no o para pero por porque que quien se si sin sobre su
también tan tengo todo un una ya yo
ei ennen ensin että han hän ja jo joka jos jossa jotta kanssa koska kuin kukaan kun minä mitä mutta myös ne niin nyt oli olla olen on onko ovat se sen siellä sitten tai taas
tämä vain vasta vielä
che di e il non per sono una het een van dat niet voor zijn och att det som på är med av
""".split()))
#: The labelling functions, in the order of a pattern's characters: p prose, n not prose, - no vote.
#: The kinds of text that is not prose, and the functions whose n speaks for each.
KINDS = {"list": ("listed",), "table": ("digits",), "code": ("code",), "junk": ("odd_words", "token_length")}
VOTES = ("common", "symbols", "sentences", "digits", "listed", "line_words", "code", "case", "token_length", "clean_words", "items", "odd_words")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def text_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text", common_words: list[str] = COMMON) -> DataFrame:
    """doc_id, n_chars, n_words, mean_word_length, symbol_share, punct_line_share, common_share for every row.

    Words are runs of letters and digits; symbols are other characters but white space, as a share of the characters;
    lines are those with any text; a share or mean of nothing is null, and so are all statistics of a null text.
    """
    t = F.col("t")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all(F.lower(t), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    n, chars = F.size("w").cast("double"), F.length(t).cast("double")
    lines, ended = _count(t, "(?md)^[^\\S\\n]*+\\S"), _count(t, "[.!?…][\"'”»)]*[ \\t\\r]*(?:\\n|$)")
    common = F.size(F.filter("w", lambda w: w.isin(common_words))).cast("double")
    of = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    symbols = _count(t, "[^\\p{L}\\p{N}\\s]")
    length = F.length(F.array_join("w", "")).cast("double")
    return rows.select("doc_id", F.length(t).cast("long").alias("n_chars"), F.when(t.isNotNull(), F.size("w").cast("long")).alias("n_words"), of(length, n).alias("mean_word_length"), of(symbols, chars).alias("symbol_share"), of(F.least(ended, lines), lines).alias("punct_line_share"), of(common, n).alias("common_share"))


def blocks(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, block: the parts of each text between blank lines and code fences, without tags, quote marks and comment marks.

    A text without any has one block, null. Passes over the text are made only where their characters occur.
    """
    has = lambda c, mark, then: F.when(F.contains(c, F.lit(mark)), then).otherwise(c)
    rows = df.select(F.col(doc_id).alias("doc_id"), has(F.col(text), "\r", F.regexp_replace(text, "\\r\\n?", "\n")).alias("t"))
    t = F.regexp_replace("t", "(?i)<pre[^<>]*>", "\n\n```\n")
    t = F.regexp_replace(t, "(?i)</(?:pre|table|ul|ol|div|p|h\\d|blockquote)>|<(?:table|ul|ol|div)[^<>]*>", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)<li[^<>]*>", "\n- "), "(?i)<br\\s*/?>|</(?:li|tr|t[dh])>", "\n")
    rows = rows.select("doc_id", has(F.col("t"), "<", F.regexp_replace(t, "</?[A-Za-z][^<>]*>", "")).alias("t"))
    rows = rows.select("doc_id", has(F.col("t"), ">", F.regexp_replace("t", "(?m)^[ \\t]*(?:>[ \\t]?)++", "")).alias("t"))
    rows = rows.select("doc_id", has(F.col("t"), "```", F.regexp_replace("t", "(?m)^[ \\t]*```[^\\n]*$", "\n\n```\n")).alias("t"))
    rows = rows.select("doc_id", F.regexp_replace("t", "(?m)^[ \\t]*(?:--|//|#+|\\*)[ \\t]+", "").alias("t"))
    parts = F.filter(F.split("t", "\\n[ \\t]*(?=\\n)|\\n(?=```)"), lambda b: b.rlike("[^\\s`]"))
    return rows.select("doc_id", F.explode_outer(parts).alias("block"))


def _shape_table() -> tuple[str, str]:
    """Sentence ends to a stop, apostrophes and hyphens to an apostrophe, other marks of prose to a comma, blanks to a space."""
    table = {x: to for xs, to in ((".!?…", "."), ("'’-–", "'"), (',:"“”„«»¿¡', ","), ("\t\r\x0b\x0c\xa0", " ")) for x in xs}
    return "".join(table), "".join(table.values())


def votes(block_rows: DataFrame, common_words: list[str] = COMMON) -> DataFrame:
    """doc_id, pattern, chars of each block: one character a labelling function; a null block has a null pattern.

    Links and short code spans within a line count as a word each, as their prose goes on around them. Most statistics
    are taken from the block's shape, in which a run of letters is one a, a run of digits one 0, and marks of a kind
    are one character: a fifth of the text, which one pass over the text gives.
    """
    has = lambda c, mark, then: F.when(F.contains(c, F.lit(mark)), then).otherwise(c)
    rows = block_rows.select("doc_id", F.trim("block", F.lit(" \t\n\r\x0b\x0c")).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("chars"), has(F.col("t"), "`", F.regexp_replace("t", "`[^`\\n]{1,80}`", "code")).alias("b"))
    links = F.regexp_replace(F.regexp_replace("b", "\\[([^\\[\\]]*)\\]\\(\\s*(?i:https?)://[^\\s()]*\\)", "$1"), "(?i:https?)://[^\\s<>\"]+", "link")
    rows = rows.select("doc_id", "chars", has(F.col("b"), "://", links).alias("b"))
    rows = rows.select("doc_id", "chars", "b", F.lower("b").alias("low"), F.regexp_replace("b", "\\p{L}++", "a").alias("s1"))
    rows = rows.select("doc_id", "chars", "b", "low", "s1", F.regexp_replace("s1", "[0-9]++", "0").alias("s2"))
    rows = rows.select("doc_id", "chars", "b", "low", F.length("b").alias("size"), F.length("s1").alias("size1"), F.length("s2").alias("size2"), F.translate("s2", *_shape_table()).alias("m"))
    m = F.col("m")
    n = lambda x: F.length(m) - F.length(F.replace(m, F.lit(x), F.lit("")))
    rows = rows.select("doc_id", "chars", "b", "low", "m", "size", n("a").alias("words"), n("\n").alias("breaks"), n(" ").alias("gaps"), (F.col("size") - F.col("size1")).alias("more_letters"), (F.col("size1") - F.col("size2") + n("0")).alias("digits"), (n(".") + n(",") + n("'") + n(";") + n("(") + n(")")).alias("usual"))
    rows = rows.withColumn("letters", F.col("more_letters") + F.col("words")).withColumn("ink", F.col("size") - F.col("breaks") - F.col("gaps"))
    # Doubles throughout, as the counts below are compared as shares.
    measured = rows.select(
        "doc_id", "chars", "ink", "digits", "letters",
        _count(F.col("b"), "[\\p{Lu}&&[\\x00-\\x{24f}]]").alias("upper"),
        (F.col("ink") - F.col("letters") - F.col("digits") - F.col("usual")).alias("marks"),
        (F.col("breaks") + 1).cast("double").alias("lines"),
        F.col("words").cast("double").alias("words"),
        F.size(F.filter(F.split("low", "[^\\p{L}]+"), lambda w: w.isin(common_words))).cast("double").alias("common"),
        _count(m, "[a0),'%][.]+[,')]*(?=\\s|$)").alias("ends"),
        _count(F.col("b"), "(?m)^(?:[ \\t]{2,}|[ \\t]*(?:[-*+•·–|$#{}<«©]|[0-9]+[.)][ \\t])).*[^\\s]|\\|[^\\n|]*\\|").alias("listed"),
        _count(m, "(?m)^ *[^ \\n]+(?: +[^ \\n]+){7}").alias("long_lines"),
        _count(m, "[{}\\[\\];=]|a\\(|'>|&&|\\|\\||a(?=[_.]a)").alias("codelike"),
        _count(m, "[^ \\n]+").alias("tokens"),
        _count(m, "(?<![^ \\n])0(?:[.,']0)*+[.,]?(?![^ \\n])").alias("numbers"),
        _count(m, "(?<![^ \\n])[(,'*_]*a(?:'a)*+[.,;)'*_]*(?![^ \\n])").alias("clean"),
        _count(F.col("low"), "[bcdfghjklmnpqrstvwxz]{5,}").alias("odd"),
    )
    c = F.col
    say = lambda prose, other: F.when(other, "n").when(prose, "p").otherwise("-")
    never = F.lit(False)
    worded = c("clean") / F.greatest(c("tokens") - c("numbers"), F.lit(1.0))  # of the tokens that are no numbers
    per = lambda a, z: c(a) / F.greatest(c(z), F.lit(1.0))
    pattern = F.concat(
        say(per("common", "words") >= 0.2, (per("common", "words") < 0.1) & (c("words") >= 8)),
        say(per("marks", "ink") < 0.02, per("marks", "ink") > 0.08),
        say((c("ends") >= 1) & (per("words", "ends") <= 45), ((c("ends") == 0) & (c("words") >= 12)) | (c("words") == 0)),
        say(never, (per("digits", "ink") > 0.2) & (c("tokens") >= 6)),
        say(never, (c("lines") >= 2) & (per("listed", "lines") >= 0.5)),
        say(per("words", "lines") >= 8, (c("lines") >= 3) & (per("words", "lines") < 4)),
        say(never, per("codelike", "tokens") > 0.12),
        say(per("upper", "letters") < 0.12, (c("letters") == 0) | ((per("upper", "letters") > 0.3) & (c("letters") >= 12))),
        say((per("ink", "tokens") >= 2.5) & (per("ink", "tokens") <= 8), per("ink", "tokens") > 14),
        say(worded >= 0.85, worded < 0.6),
        say(never, (c("lines") >= 3) & (c("long_lines") == 0) & (c("ends") == 0)),
        say(never, (per("odd", "words") > 0.1) & (c("odd") >= 2)),
    )
    return measured.select("doc_id", F.when(F.col("chars").isNotNull(), pattern).alias("pattern"), "chars")


def learn(patterns: list[str], counts: list[int], rounds: int = 60) -> np.ndarray:
    """Posterior of prose for each pattern, by EM from the balance of its votes.

    Each function has, for either class, a distribution over its three answers. A small prior on either class keeps
    the answer p likelier for prose, and n for the rest, so that the classes cannot trade places.
    """
    n = np.asarray(counts, dtype=float)
    x = np.array([[("n", "-", "p").index(v) for v in p] for p in patterns])
    one_hot = np.eye(3)[x]
    post = 1 / (1 + np.exp(-(x - 1).sum(axis=1).astype(float)))
    prior = 2.0 * np.array([[2.0, 1.0, 0.2], [0.2, 1.0, 2.0]])
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        share = (w.sum(axis=1) + 1) / (n.sum() + 2)
        given = np.einsum("cp,pfv->cfv", w, one_hot) + prior[:, None, :]
        given /= given.sum(axis=2, keepdims=True)
        score = np.log(share)[:, None] + np.einsum("pfv,cfv->cp", one_hot, np.log(given))
        now = 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))
        if np.abs(now - post).max() < 1e-6:
            return now
        post = now
    return post


def learn_kinds(patterns: list[str], weights: list[float], rounds: int = 60) -> np.ndarray:
    """Posterior of each of KINDS for each pattern, given that it is not prose, by EM from the votes that speak for each kind."""
    n = np.asarray(weights, dtype=float) + 1e-9
    x = np.array([[("n", "-", "p").index(v) for v in p] for p in patterns])
    one_hot = np.eye(3)[x]
    own = np.array([[v in fs for v in VOTES] for fs in KINDS.values()], dtype=float)
    score = ((x == 0) @ own.T) / own.sum(axis=1)
    post = np.exp(4 * score)
    post /= post.sum(axis=1, keepdims=True)
    prior = np.where(own[:, :, None] > 0, [8.0, 1.0, 0.5], [1.0, 2.0, 1.0])
    for _ in range(rounds):
        w = n[:, None] * post
        share = (w.sum(axis=0) + 1) / (n.sum() + len(KINDS))
        given = np.einsum("pk,pfv->kfv", w, one_hot) + prior
        given /= given.sum(axis=2, keepdims=True)
        score = np.log(share) + np.einsum("pfv,kfv->pk", one_hot, np.log(given))
        now = np.exp(score - score.max(axis=1, keepdims=True))
        now /= now.sum(axis=1, keepdims=True)
        if np.abs(now - post).max() < 1e-6:
            return now
        post = now
    return post


def text_types(df: DataFrame, doc_id: str = "doc_id", text: str = "text", common_words: list[str] = COMMON) -> DataFrame:
    """doc_id, prose_share, text_type (prose, list, table, code or junk) of every text that is neither null nor blank.

    A text is prose if at least half of its characters are, by posterior; else it is what most of its other characters
    are. A text of marks only, such as a lone fence, is junk. Rows with a null doc_id are left out; repeated rows with
    one doc_id count as one text; an empty table gives no rows. The functions' behaviour is learnt from all blocks of
    df at once.
    """
    texts = df.where(F.col(doc_id).isNotNull() & F.col(text).rlike("\\S"))
    voted = stage(votes(blocks(on_all_cores(texts.select(doc_id, text)), doc_id, text), common_words))
    table = voted.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3 ** 12 rows
    patterns, counts = [r.pattern for r in table], [r.n for r in table]
    post = learn(patterns, counts) if table else np.zeros(0)
    kinds = learn_kinds(patterns, [*(np.asarray(counts) * (1 - post))]) if table else np.zeros((0, len(KINDS)))
    rows = [(p, float(x), *(float((1 - x) * y) for y in k)) for p, x, k in zip(patterns, post, kinds)]
    known = df.sparkSession.createDataFrame(rows, "pattern string, prose double, " + ", ".join(f"`{k}` double" for k in KINDS))
    share = lambda c: F.coalesce(F.sum(F.col("chars") * F.col(c)) / F.sum("chars"), F.lit(0.0)).alias(c)
    scored = voted.join(F.broadcast(known), "pattern", "left").groupBy("doc_id").agg(*[share(c) for c in ("prose", *KINDS)])
    top = F.greatest(*KINDS)
    kind = F.coalesce(*[F.when((top > 0) & (F.col(k) == top), k) for k in KINDS], F.lit("junk"))
    return scored.select("doc_id", F.col("prose").alias("prose_share"), F.when(F.col("prose") < 0.5, kind).otherwise("prose").alias("text_type"))

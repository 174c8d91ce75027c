"""Benchmark decontamination by template windows, in DataFrame and SQL functions alone.

Each text becomes a template: words without outer punctuation, in lower case, but numbers, measures, units behind numbers and
names (capitalised words inside a sentence) give way to typed placeholders; what stood there is the window's slots. Windows of
`window` template words (shorter items: the item's length, `least` at least) are hash-joined with those of the benchmark. A pair
(document, item) is a leak when at least `share` of the item's distinct windows occur in the document and the slots agree: each
slot value of the item stands, across the windows, for one value in the document (`consistency`, the share of such pairs). So an
exact copy and a re-parameterised question are both found, and text that only shares the shape of a sentence is not. A document may
hold several variants of an item, which disagree with each other: where the document as a whole isn't a leak, each occurrence (the hits
at one offset between document and item, or at offsets closer than occurrences can follow each other) is judged alone, and the best
one is reported. Whether a word counts as a name or unit depends on the word before it, which a copy needn't share; so a window of an
item whose first word can be of another kind is also posted under that kind, and then matches the very same first word only.

Whatever the share and the slots, `run` words of an item in a row that stand in the document word for word are a leak as well; the figures
are then those of that occurrence, so its share can lie below `share`.

ORACLE_SQL has none of these three; every row of it is in the result with the same figures, and the others come on top.

The benchmark's windows are broadcast when they number at most `most_broadcast`; else the join shuffles by window hash.
Nulls: a null text or item has no words and takes no part, nor do items shorter than `least`. Rows with a null doc_id or item_id
keep it. Repeated rows give one result row for each (doc_id, item_id). Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
#: Punctuation that may stand around a word.
OUTER = ".,;:!?\"'()[]{}<>|#$%&*_+=~`^@/\\-“”‘’«»„…—–"
#: Units that may follow a number.
UNITS = "mm cm m km g kg mg l ml s sec min h hr hours minutes seconds days years percent usd eur dollars euros miles feet inches pounds kmh mph °c °f".split()
NUMBER = r"^[0-9]+([.,:/][0-9]+)*$"
MEASURE = r"^[0-9]+([.,][0-9]+)*(" + "|".join(u for u in UNITS if u.isascii()) + ")$"
STOPS = (".", "!", "?", ":")


def settled(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """With the columns worked out once for each row: a lambda that refers to them would else work them out for every element."""
    made = df.select(*keys, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_"))
    return made.select(*keys, *(F.col(f"_.{k}").alias(k) for k in columns))


def templates(df: DataFrame, key: str, others: bool = False) -> DataFrame:
    """key, words (template), slots (what a placeholder stands for, else null); with others, the forms a word can have behind other words."""
    raw = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES), lambda w: w != "")
    df = settled(df, [key], raw=raw)
    df = settled(df, [key, "raw"], bare=F.transform("raw", lambda w: F.btrim(w, F.lit(OUTER))))
    df = settled(df, [key, "raw", "bare"], core=F.transform("bare", lambda w: F.lower(w)))

    def word(w: Column, i: Column, forms: bool = False) -> Column:
        bare = F.get("bare", i)
        digit = F.ascii(w).between(48, 57)
        named = (bare != w) & (F.lower(F.substring(bare, 1, 1)) != F.substring(bare, 1, 1)) & (F.upper(F.substring(bare, 2, 1)) != F.substring(bare, 2, 1))
        if forms:
            return F.when(~(digit & (w.rlike(NUMBER) | w.rlike(MEASURE))), F.array_compact(F.array(w, F.when(w.isin(UNITS), "<unit>"), F.when(named, "<name>"))))
        return (
            F.when(digit & w.rlike(NUMBER), "<num>").when(digit & w.rlike(MEASURE), "<measure>")
            .when(w.isin(UNITS) & (i > 0) & F.get("core", i - 1).rlike(NUMBER), "<unit>")
            .when(named & (i > 0) & ~F.substring(F.get("raw", i - 1), -1, 1).isin(*STOPS), "<name>").otherwise(w)
        )

    kept = [key]
    if others:
        df, kept = settled(df, [key, "raw", "bare", "core"], others=F.transform("core", lambda w, i: word(w, i, True))), [key, "others"]
    df = settled(df, [*kept, "core"], words=F.transform("core", lambda w, i: word(w, i)))
    return settled(df, [*kept, "words"], slots=F.transform("words", lambda w, i: F.when(w.startswith("<"), F.get("core", i))))


def _with_later(span: int):
    return lambda p, i: F.xxhash64(p, F.get("prints", i + span))


def windows(df: DataFrame, key: str, n: int, only: list[int] | None = None) -> DataFrame:
    """key, n, at, hash, slots for each window of n words, or for those whose hash is one of only.

    Elements are taken one by one: slice() would copy the whole array each time.
    """
    df = settled(df.where(F.size("words") >= n), [key, "slots"], prints=F.transform("words", lambda w: F.xxhash64(w)))
    span, left = 1, n
    while left > 1 and left % 2 == 0:  # hashes of pairs, of pairs of pairs, ...
        df = settled(df, [key, "slots"], prints=F.transform("prints", _with_later(span)))
        span, left = span * 2, left // 2
    each = F.transform(
        F.sequence(F.lit(0), F.size("prints") - n),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get("prints", i + k * span) for k in range(left)), F.lit(n)).alias("hash")),
    )
    if only is not None:
        each = F.filter(each, lambda w: w["hash"].isin(only))
    df = settled(df, [key, "slots"], w=each)
    each = F.transform("w", lambda w: F.struct(w["at"].alias("at"), w["hash"].alias("hash"), F.array_compact(F.array(*(F.get("slots", w["at"] + k) for k in range(n)))).alias("slots")))
    return df.select(key, F.lit(n).alias("n"), F.explode(each).alias("w")).select(key, "n", "w.at", "w.hash", "w.slots")


def _hash(words: list[Column]) -> Column:
    """Of one window, as windows() has it."""
    n, prints = len(words), [F.xxhash64(w) for w in words]
    while len(prints) > 1 and len(prints) % 2 == 0:
        prints = [F.xxhash64(a, b) for a, b in zip(prints[::2], prints[1::2], strict=True)]
    return F.xxhash64(*prints, F.lit(n))


def openings(df: DataFrame, key: str, n: int) -> DataFrame:
    """As windows(): those whose first word is a name, a unit or plain only because of what stands before it, in each other form. The
    first word is no slot here; where the form is a placeholder, it must be the same word (first). base: the hash in the item's own form."""
    df = df.where(F.size("words") >= n).select(key, "words", "slots", "others", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    own = F.get("words", F.col("at"))
    df = settled(df, [key, "words", "slots", "at"], own=own, core=F.coalesce(F.get("slots", F.col("at")), own), forms=F.array_remove(F.get("others", F.col("at")), own))
    df = df.select(key, "words", "slots", "at", "own", "core", F.explode("forms").alias("form"))
    rest = [F.get("words", F.col("at") + k) for k in range(1, n)]
    slots = F.array_compact(F.array(*(F.get("slots", F.col("at") + k) for k in range(1, n))))
    return df.select(key, F.lit(n).alias("n"), "at", _hash([F.col("form"), *rest]).alias("hash"), slots.alias("slots"), F.when(F.col("form").startswith("<"), F.col("core")).alias("first"), _hash([F.col("own"), *rest]).alias("base"))


def _identified(df: DataFrame, key: str, name: str) -> DataFrame:
    """text and, as one column, its key and fingerprint: rows that share a key keep places of their own."""
    return df.where("text is not null").select(F.struct(key, F.xxhash64(F.col("text").cast("string")).alias("print")).alias(name), "text")


def _together(places: Column, prefix: str = "") -> Column:
    """The windows and pairs of all the places."""
    seen, pairs = (F.transform(places, lambda p: p[f"{prefix}seen"]), F.transform(places, lambda p: p[f"{prefix}pairs"]))
    return F.struct(F.array_distinct(F.flatten(seen)).alias("seen"), F.array_distinct(F.flatten(pairs)).alias("pairs"))


def _figures(p: Column) -> Column:
    n_slots = F.size(F.array_distinct(F.transform(p["pairs"], lambda z: z["theirs"]))).cast("long")
    agreed = F.when(F.size(p["pairs"]) > 0, n_slots / F.size(p["pairs"])).otherwise(1.0)
    return F.struct(F.size(p["seen"]).cast("long").alias("n_matched"), agreed.alias("consistency"), n_slots.alias("n_slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, share: float = 0.5, consistency: float = 0.75, most_broadcast: int = 1_000_000, most_listed: int = 50_000, run: int = 13) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, share, n_slots, consistency: one row for each leak. run: words in a row that are one by themselves."""
    items = templates(_identified(benchmark, "item_id", "item"), "item", others=True)
    by_length = [(items.where(F.size("words") == n if n < window else F.size("words") >= n), n) for n in range(least, window + 1)]
    plain = [windows(t, "item", n).select("*", F.lit(None).cast("string").alias("first"), F.col("hash").alias("base")) for t, n in by_length]
    items = reduce(DataFrame.unionByName, [*plain, *(openings(t, "item", n) for t, n in by_length)])
    items = written(items, docs.sparkSession, "items")
    lengths, rows = [r.n for r in items.select("n").distinct().collect()], items.count()
    told = items.where("hash = base").groupBy("item.item_id").agg(F.countDistinct("n", "hash").alias("n_windows"))
    keyed = items.groupBy("n", "hash").agg(F.collect_set(F.struct("item", "at", "slots", "first", "base")).alias("items"))
    t = templates(_identified(docs, "doc_id", "doc"), "doc")
    small = rows <= most_broadcast
    listed = {}  # a hash set inside the expression drops most windows before they become rows
    if rows <= most_listed:
        for r in items.select("n", "hash").distinct().collect():
            listed.setdefault(r.n, []).append(r.hash)
    mine = reduce(DataFrame.unionByName, [windows(t, "doc", n, listed.get(n)) for n in sorted(lengths) or [window]])
    hit = mine.select("doc", "n", "hash", "at", F.col("slots").alias("own")).join(F.broadcast(keyed) if small else keyed, ["n", "hash"])
    hit = hit.select("doc", "hash", "at", "own", F.explode("items").alias("i")).where("i.first is null or own[0] = i.first")
    own = F.when(F.col("i.first").isNull(), F.col("own")).otherwise(F.slice("own", 2, window))
    hit = hit.select("doc", "i.item", (F.col("at") - F.col("i.at")).alias("off"), F.col("i.at").alias("from"), F.col("i.base").alias("window"), (F.col("hash") == F.col("i.base")).alias("plain"), "i.slots", own.alias("own"))
    hit = hit.withColumn("pairs", F.arrays_zip(F.col("slots").alias("theirs"), "own")).withColumn("literal", F.when(F.col("slots") == F.col("own"), F.col("from")))

    def gathered(prefix: str, which: Column) -> list[Column]:
        return [F.collect_set(F.when(which, F.col("window"))).alias(f"{prefix}seen"), F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col("pairs"))))).alias(f"{prefix}pairs")]

    found = hit.groupBy("doc", "item", "off").agg(*gathered("", F.lit(True)), *gathered("plain_", F.col("plain")), F.sort_array(F.collect_set("literal")).alias("literal"))
    more = max(run - window, 0)  # so many windows after the first one; an item of less than window words has only one
    ran = F.exists(F.transform("literal", lambda a, k: F.get("literal", k + more) - a), lambda gap: gap == more)
    found = found.withColumn("ran", F.coalesce(ran, F.lit(False)))
    texts = F.struct("doc.print", F.col("item.print").alias("of")).alias("texts")
    found = found.groupBy("doc.doc_id", "item.item_id").agg(F.collect_list(F.struct(texts, "off", "seen", "pairs", "plain_seen", "plain_pairs", "ran")).alias("places"))
    out = found.alias("a").join((F.broadcast(told) if small else told).alias("b"), F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).select("a.doc_id", "a.item_id", "n_windows", "places")
    keys = ["doc_id", "item_id", "n_windows"]
    out = settled(out, [*keys, "places"], plain=_together(F.col("places"), "plain_"), whole=_together(F.col("places")))
    out = out.where((F.size("whole.seen") / F.col("n_windows") >= share) | F.exists("places", lambda p: p["ran"]))
    out = settled(out, [*keys, "places"], plain=_figures(F.col("plain")), whole=_figures(F.col("whole")))

    def leak(f: Column) -> Column:
        return (f["n_matched"] / F.col("n_windows") >= share) & (f["consistency"] >= consistency)

    def near(p: Column) -> Column:
        """The hits of one occurrence that begins at p: words put in or left out move the offset."""
        return F.filter("places", lambda q: (q["texts"] == p["texts"]) & (q["off"] >= p["off"]) & (q["off"] < p["off"] + F.col("n_windows") * share))

    each = F.concat(F.array("whole"), F.transform("places", lambda p: _figures(p)), F.transform("places", lambda p: _figures(_together(near(p)))))
    best = F.when(leak(F.col("plain")), F.col("plain")).otherwise(F.coalesce(F.array_max(F.filter(each, leak)), F.array_max(F.transform(F.filter("places", lambda p: p["ran"]), _figures))))
    out = settled(out, keys, best=best).where("best is not null")
    return out.select("doc_id", "item_id", "n_windows", "best.n_matched", (F.col("best.n_matched") / F.col("n_windows")).alias("share"), "best.n_slots", "best.consistency")



_WORDS = """
{name}_raw AS (SELECT {key}, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS raw FROM {table} WHERE text IS NOT NULL),
{name}_bare AS (SELECT {key}, raw, list_transform(raw, lambda w: trim(w, '{outer}')) AS bare FROM {name}_raw),
{name}_core AS (SELECT {key}, raw, bare, list_transform(bare, lambda w: lower(w)) AS core FROM {name}_bare),
{name}_words AS (SELECT {key}, core, list_transform(range(1, len(raw) + 1), lambda i: CASE
    WHEN regexp_matches(core[i], '{number}') THEN '<num>' WHEN regexp_matches(core[i], '{measure}') THEN '<measure>'
    WHEN core[i] IN ({units}) AND i > 1 AND regexp_matches(core[i - 1], '{number}') THEN '<unit>'
    WHEN i > 1 AND lower(bare[i][1]) <> bare[i][1] AND upper(bare[i][2]) <> bare[i][2] AND right(raw[i - 1], 1) NOT IN ('.', '!', '?', ':') THEN '<name>' ELSE core[i] END) AS words FROM {name}_core)"""


def _part(name: str, key: str, table: str) -> str:
    return _WORDS.format(name=name, key=key, table=table, number=NUMBER, measure=MEASURE, units=", ".join(f"'{u}'" for u in UNITS), outer=OUTER.replace("'", "''"))


ORACLE_SQL = f"""
WITH {_part("item", "item_id", "benchmark")}, {_part("doc", "doc_id", "documents")},
item_w AS (SELECT item_id, n, words[i:i + n - 1] AS w, core[i:i + n - 1] AS c FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM (SELECT *, least(len(words), 8) AS n FROM item_words WHERE len(words) >= 5))),
lengths AS (SELECT DISTINCT n FROM item_w),
doc_w AS (SELECT doc_id, n, words[i:i + n - 1] AS w, core[i:i + n - 1] AS c FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM doc_words, lengths WHERE len(words) >= n)),
hit AS (SELECT DISTINCT d.doc_id, i.item_id, d.w, d.c AS own, i.c AS theirs FROM doc_w d JOIN item_w i ON d.w = i.w),
told AS (SELECT item_id, count(DISTINCT w) AS n_windows FROM item_w GROUP BY 1),
matched AS (SELECT doc_id, item_id, count(DISTINCT w) AS n_matched FROM hit GROUP BY 1, 2),
pairs AS (SELECT DISTINCT doc_id, item_id, theirs[k] AS t, own[k] AS o FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM hit) WHERE w[k] LIKE '<%'),
slots AS (SELECT doc_id, item_id, count(DISTINCT t) AS n_slots, count(*) AS n_pairs FROM pairs GROUP BY 1, 2)
SELECT m.doc_id, m.item_id, n_windows, n_matched, n_matched / n_windows AS share, coalesce(n_slots, 0) AS n_slots, coalesce(n_slots / n_pairs, 1.0)::DOUBLE AS consistency
FROM matched m JOIN told USING (item_id) LEFT JOIN slots USING (doc_id, item_id)
WHERE n_matched >= 0.5 * n_windows AND coalesce(n_slots / n_pairs, 1.0) >= 0.75
"""

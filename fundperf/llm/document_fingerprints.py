"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs: what stands between line ends, and in lines of several sentences each sentence.
A paragraph's vector has WORDS * 32 entries, the bits of its MD5; a text's fingerprint is the number of its paragraphs
and the sum of their vectors, each entry modulo 2**32. So the order of paragraphs doesn't matter, and paragraphs
are added to or taken from a fingerprint without the text (``plus``, ``minus``). With bits read as +1 and -1, the
product of two sums is, but for chance, the number of paragraphs that both texts have: their cosine is the
likeness, off by about 0.09 for texts that share nothing.

To put a document next to the one that follows by doc_id, rows are dealt out by ranges of doc_id (cut at quantiles) in
one shuffle of the texts; the first rows of each range are dealt to the range before as well. All that follows
(window, sums of paragraphs, the next fingerprint) keeps that partitioning. Two entries travel in one long integer.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, version_of

PARAGRAPH_END = r"\n|[.!?] "
#: 32-bit words of a paragraph's MD5.
WORDS = 4
#: Each long holds entry ``bit`` of two of the words: one of them counted from bit 32 on.
PAIR = 0x100000001
#: Ranges of doc_id for each shuffle partition, and at most; their first keys pass through the driver.
RANGES, MAX_RANGES = 8, 8192
#: Copies of one row that are worked out as one from this many on, if they are more than a range's rows.
LEAST_COPIES = 1000
#: Copies written by one task.
COPIES_A_TASK = 100_000
KEY = ("doc_id", "version")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END, -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def paragraph_bits(paragraph: Column) -> Column:
    """The words of a paragraph's MD5, in pairs as two long integers."""
    digest = F.md5(paragraph.cast("binary"))
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(WORDS)]
    return F.struct(
        *[words[k].bitwiseOR(F.shiftleft(words[k + 1], 32)).alias(f"bits{k // 2}") for k in range(0, WORDS, 2)]
    )


def bit_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n (paragraphs) and the packed sums of ``bits``, of all rows with equal keys."""
    sums = [
        F.coalesce(F.sum(F.shiftrightunsigned(F.col(f"bits.bits{k}"), bit).bitwiseAND(F.lit(PAIR))), F.lit(0))
        for k in range(WORDS // 2)
        for bit in range(32)
    ]
    return rows.groupBy(*keys).agg(F.count("bits.bits0").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])


def packed() -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(WORDS * 16)])


def written(n: Column, sums: Column) -> Column:
    """A fingerprint as text: 8 hex digits of the count, 16 of each pair of entries."""
    parts = F.transform(sums, lambda s: F.lpad(F.hex(s), 16, "0"))
    return F.lower(F.concat(F.lpad(F.hex(n), 8, "0"), F.array_join(parts, "")))


def entries(fingerprint: Column) -> Column:
    """The 32-bit numbers of a written fingerprint."""
    places = F.sequence(F.lit(0), F.lit(WORDS * 32))
    return F.transform(places, lambda k: F.conv(F.substr(fingerprint, 8 * k + 1, F.lit(8)), 16, 10).cast("long"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    sums = F.zip_with(entries(a), entries(b), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    return F.lower(F.array_join(F.transform(sums, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of ``a`` without those of ``b``."""
    return _combined(a, b, -1)


def signed(n: Column, sums: Column) -> Column:
    """The entries with bits read as +1 and -1."""
    low = F.transform(sums, lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 - n)
    high = F.transform(sums, lambda s: F.shiftrightunsigned(s, 32) * 2 - n)
    return F.concat(low, high)


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda acc, x: acc + x)


def likeness(a: str, b: str) -> Column:
    """Cosine of two fingerprints (structs of n, sums, entries and their square), not below 0; 1 for equal ones."""
    x, y = F.col(a), F.col(b)
    cosine = product(x["entries"], y["entries"]).cast("double") / F.sqrt(
        x["square"].cast("double") * y["square"].cast("double")
    )
    return (
        F.when((x["n"] == y["n"]) & (x["sums"] == y["sums"]), F.lit(1.0))
        .when((x["square"] == 0) | (y["square"] == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))
    )


def at_most(values: list[int], x: Column) -> Column:
    """How many of the ascending ``values`` are at most ``x``."""
    if not values:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def halved(found: Column, _: Column) -> Column:
        low, high = found["low"], found["high"]
        middle = F.floor((low + high) / 2).cast("int")
        right = (low < high) & (F.get(known, F.least(middle, F.lit(len(values) - 1))) <= x)
        return F.struct(
            F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right, high).otherwise(middle).alias("high")
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(values)).alias("high"))
    steps = F.sequence(F.lit(0), F.lit(len(values).bit_length()))
    return F.aggregate(steps, start, halved, lambda found: found["low"])


def range_of(keys: DataFrame, ranges: int) -> Column:
    """The range of a row's key: ranges follow each other as the keys do, null doc_ids last.

    Ranges begin at quantiles of doc_id. A doc_id that several quantiles hit, or a share of null ones, is split by
    the digest of the text into as many ranges.
    """
    quantiles = [i / ranges for i in range(1, ranges)] or [0.5]
    row = keys.agg(
        F.percentile_approx("doc_id", quantiles, 8 * ranges).alias("cuts"),
        F.count("*").alias("all"),
        F.count("doc_id").alias("named"),
    ).first()
    hits = Counter(row["cuts"] or [])
    cuts = sorted(hits)
    split = {len(cuts) + 1: max(1, round((row["all"] - row["named"]) * ranges / max(1, row["all"])))}
    split |= {i + 1: hits[c] for i, c in enumerate(cuts) if hits[c] > 1}
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(at_most(cuts, F.col("doc_id")))
    share = F.conv(F.hex(F.substring("version", 1, 4)), 16, 10).cast("long") / F.lit(float(1 << 32))
    places = sorted(split)
    at = at_most(places, F.col("place"))
    shares = F.split(F.lit(",".join(str(split[p]) for p in places)), ",").cast("array<int>")
    first = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    own = F.when((at > 0) & (F.try_element_at(first, at) == F.col("place")), F.try_element_at(shares, at)).otherwise(1)
    start = F.split(F.lit(",".join(map(str, [0, *cuts]))), ",").cast("array<bigint>")
    on_cut = F.col("doc_id").isNull() | (F.get(start, F.col("place")) == F.col("doc_id")) & (F.col("place") > 0)
    within = F.when(on_cut, F.floor(share * F.col("own")).cast("int")).otherwise(F.when(F.col("own") > 1, F.col("own")).otherwise(0))
    return place, own, within


def dealt(df: DataFrame, parts: tuple[Column, Column, Column]) -> DataFrame:
    place, own, within = parts
    return df.withColumn("place", place).withColumn("own", own).withColumn(
        "part", F.col("place").cast("long") * (1 << 24) + within
    ).drop("place", "own")


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is the one that follows by doc_id and then by digest of the text; null doc_ids come last, and
    the first follows the last. A null text is empty; texts without paragraphs have fingerprint zero and are
    alike. Repeated rows stay rows and follow each other; where they are more than a range's rows, all but the last
    are worked out once. Other columns aren't read; an empty table gives an empty result; a table of one row is
    its own next. A very long text is one row of one task; its paragraphs are summed as they come.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), version_of().alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    keys = cut(keyed.groupBy(*KEY).agg(F.count("*").alias("copies")))
    ranges = min(MAX_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = range_of(keys, ranges)
    rows, repeated = keyed, None
    total = keys.agg(F.sum("copies")).first()[0] or 0
    # At most as many rows as ranges: each stands for that share of all rows.
    hot = keys.filter(F.col("copies") > max(LEAST_COPIES, total // ranges))
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        repeated = (
            keyed.join(hot, same_key(keyed, hot))
            .select(keyed["doc_id"], keyed["version"], "text", "copies")
            .groupBy(*KEY, "copies")
            .agg(F.first("text").alias("text"))
        )
        rows = keyed.join(hot, same_key(keyed, hot), "left_anti").unionByName(repeated.drop("copies"))
    # A row for each range: its first key, and the range before it, for the first one the last.
    firsts = cut(dealt(keys, parts).groupBy("part").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), *KEY)).alias("key")))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    border = F.broadcast(firsts.select("key.doc_id", "key.version", before.alias("to_part")))
    rows = dealt(rows, parts)
    marked = rows.join(border, same_key(rows, border), "left").select(
        rows["doc_id"], rows["version"], "text", "part", "to_part"
    )
    places = F.filter(
        F.array(
            F.struct(F.col("part"), F.lit(False).alias("border")),
            F.struct(F.col("to_part").alias("part"), F.lit(True).alias("border")),
        ),
        lambda p: p["part"].isNotNull(),
    )
    placed = marked.select(*KEY, "text", F.explode(places).alias("at")).select(
        *KEY, "text", "at.part", "at.border", F.isnull("doc_id").alias("none")
    )
    by_key = Window.partitionBy("part").orderBy("border", "none", *KEY)
    followed = placed.select("*", F.row_number().over(by_key).alias("place"), F.lead("text").over(by_key).alias("next"))
    done = compared(followed)
    if repeated is not None:
        selves = compared(
            repeated.select(
                *KEY,
                "text",
                F.monotonically_increasing_id().alias("part"),
                F.lit(False).alias("border"),
                F.lit(0).alias("place"),
                F.col("text").alias("next"),
                (F.col("copies") - 1).alias("more"),
            ),
            "more",
        )
        done = done.unionByName(copied(cut(selves.withColumn("near_next", F.lit(1.0)))))
    return done


def compared(followed: DataFrame, *kept: str) -> DataFrame:
    """Rows with the text that follows, as result rows; rows of ``border`` are only looked at."""
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    # The start of the text, and as much of the next one as was cut off.
    edited = F.when(F.col("border"), F.lit("")).otherwise(
        F.concat(F.left(F.col("text"), n - half), F.left(F.coalesce("next", F.lit("")), half))
    )
    texts = followed.select("part", "place", "doc_id", "border", *kept, "text", n.cast("long").alias("n_chars"), edited.alias("edited"))

    def marks(which: int, text: str) -> Column:
        none = F.lit(None).cast(f"struct<{', '.join(f'bits{k}: bigint' for k in range(WORDS // 2))}>")
        own = F.transform(paragraphs(F.col(text)), lambda p: F.struct(F.lit(which).alias("which"), paragraph_bits(p).alias("bits")))
        return F.concat(F.array(F.struct(F.lit(which).alias("which"), none.alias("bits"))), own)

    names = ["part", "place", "doc_id", "border", *kept, "n_chars", "edited_sha256"]
    each = texts.select(
        *[name for name in names if name != "edited_sha256"],
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.concat(marks(0, "text"), marks(1, "edited"))).alias("mark"),
    ).select(*names, "mark.which", "mark.bits")
    vectors = bit_sums(each, [*names, "which"]).select(*names, "which", "n", packed().alias("sums"))
    whole = vectors.withColumn("entries", signed(F.col("n"), F.col("sums")))
    whole = whole.select(
        *names, "which", F.struct("n", "sums", "entries", product(F.col("entries"), F.col("entries")).alias("square")).alias("v")
    )
    both = whole.groupBy(*names).agg(
        F.first(F.when(F.col("which") == 0, F.col("v")), ignorenulls=True).alias("own"),
        F.first(F.when(F.col("which") == 1, F.col("v")), ignorenulls=True).alias("edited"),
    )
    by_place = Window.partitionBy("part").orderBy("place")
    return (
        both.withColumn("next", F.lead("own").over(by_place))
        .filter(~F.col("border"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            written(F.col("own.n"), F.col("own.sums")).alias("fingerprint"),
            written(F.col("edited.n"), F.col("edited.sums")).alias("edited_fingerprint"),
            likeness("own", "edited").alias("near_edited"),
            likeness("own", "next").alias("near_next"),
            *kept,
        )
    )


def copied(rows: DataFrame) -> DataFrame:
    """Each row ``more`` times, written by as many tasks as that needs."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("more") - 1) / COPIES_A_TASK))
    dealt_ = rows.withColumn("piece", F.explode(pieces)).repartition("doc_id", "piece")
    own = F.least(F.lit(COPIES_A_TASK), F.col("more") - F.col("piece") * COPIES_A_TASK).cast("int")
    return dealt_.withColumn("copy", F.explode(F.sequence(F.lit(1), own))).drop("more", "piece", "copy")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    bits = [f"sum((w{k} >> {bit}) & 1)::BIGINT" for k in range(WORDS) for bit in range(32)]
    words = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS w{k}" for k in range(WORDS))
    # The order in which entries are written: for each bit of a pair of words, first the second word's.
    order = [32 * (2 * pair + word) + bit + 1 for pair in range(WORDS // 2) for bit in range(32) for word in (1, 0)]

    def near(a: str, b: str) -> str:
        dot = f"list_inner_product([(2 * x - {a}.n)::DOUBLE for x in {a}.c], [(2 * x - {b}.n)::DOUBLE for x in {b}.c])"
        square = [dot.replace(f"{b}.", f"{x}.").replace(f"{a}.", f"{x}.") for x in (a, b)]
        return (
            f"CASE WHEN {a}.n = {b}.n AND {a}.c = {b}.c THEN 1.0 WHEN {square[0]} = 0 OR {square[1]} = 0 THEN 0.0 "
            f"ELSE greatest(0.0, least(1.0, {dot} / sqrt({square[0]} * {square[1]}))) END::DOUBLE"
        )

    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
        row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS place, count(*) OVER () AS total
    FROM documents
), followed AS (
    SELECT a.doc_id, a.place, a.total, a.text, left(a.text, (length(a.text) - length(a.text) // 2)::BIGINT)
        || left(b.text, (length(a.text) // 2)::BIGINT) AS edited
    FROM texts a JOIN texts b ON b.place = a.place % a.total + 1
), marks AS (
    SELECT place, 0 AS which, unnest(string_split_regex(text, '\n|[.!?] ')) AS p FROM followed
    UNION ALL
    SELECT place, 1, unnest(string_split_regex(edited, '\n|[.!?] ')) FROM followed
), hashed AS (
    SELECT place, which, md5(p) AS h FROM marks WHERE regexp_matches(p, '[^\x20\x09-\x0D]')
), words AS (
    SELECT place, which, {words} FROM hashed
), summed AS (
    SELECT place, which, count(*) AS n, [{", ".join(bits)}] AS c FROM words GROUP BY ALL
), vectors AS (
    SELECT f.place, w.which, coalesce(s.n, 0) AS n, coalesce(s.c, [0::BIGINT for i in range({WORDS * 32})]) AS c
    FROM followed f CROSS JOIN (VALUES (0), (1)) w(which)
    LEFT JOIN summed s ON s.place = f.place AND s.which = w.which
), shown AS (
    SELECT *, format('{{:08x}}', n) || array_to_string([format('{{:08x}}', c[i]) for i in {order}], '') AS fp
    FROM vectors
)
SELECT f.doc_id, length(f.text)::BIGINT AS n_chars, sha256(f.edited) AS edited_sha256, o.fp AS fingerprint,
    e.fp AS edited_fingerprint, {near("o", "e")} AS near_edited, {near("o", "x")} AS near_next
FROM followed f JOIN shown o ON o.place = f.place AND o.which = 0 JOIN shown e ON e.place = f.place AND e.which = 1
JOIN shown x ON x.place = f.place % f.total + 1 AND x.which = 0
"""


ORACLE_SQL = _oracle()

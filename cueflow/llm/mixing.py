"""Mixing sources to target weights, in DataFrame operations only.

The words of a source are dealt into blocks: a document's block is a hash of its id, and the
blocks of a source stand in an order of their own. A source's target is taken as whole passes over
all its blocks and the first blocks of one more pass, the last of them in part; so every draw is
of another block, and the words taken meet the target. Which output shard gets which draw is
decided by a splitting tree: a node's draws are ordered by a hash and halved, so the number of each
source that goes left is a multivariate hypergeometric draw, and the quotas add up exactly. Within
a shard, rows are ordered by a hash.

A source has at most ``MOST_BLOCKS`` blocks, so the tables of blocks and draws are small however
long a source is, and the one block that is taken in part holds a small share of it.

Defined results: a null or empty text has size 0 and nothing is taken from it; null is a source
like others and comes last; repeated rows are documents of their own and share what is taken of
them; an empty table, or one without words, takes nothing. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.registry import query

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
BLOCK_WORDS, MOST_BLOCKS = 5_000, 4096
LEVELS = 4  # 16 output shards
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def unit(*parts: Column) -> Column:
    """A hash of the parts: 52 bits as a long, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with its key of the source, size in words and hash."""
    return docs.withColumns({
        "_key": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("z")),
        "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_h": unit(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
    })


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Per source: size, target and how it is taken. One row per source from the first step on.

    Targets are a common level times the weight, stopped at the limit: with sources in order of
    limit / weight, the level is what the stopped ones leave, over the weights of the others.
    """
    s = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    n = F.pmod(F.row_number().over(Window.orderBy("_key")) - 1, F.lit(len(weights)))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    s = s.withColumn("most", F.lit(limit) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    upto = Window.orderBy("ratio", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"_c": F.sum("most").over(upto) - F.col("most"), "_w": F.sum("weight").over(upto) - F.col("weight"), "_all": F.sum("weight").over(everything), "_t": F.sum("source_size").over(everything) * F.lit(share)})
    s = s.withColumn("_level", (F.col("_t") - F.col("_c")) / (F.col("_all") - F.col("_w")))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("ratio"), F.col("_level"))).over(everything))
    s = s.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("_level") * F.col("weight"), F.col("most"))))
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    s = s.withColumn("n_blocks", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long"))
    return s.select("_key", "source_size", "target", "passes", "rest", F.greatest(F.col("n_blocks"), F.lit(1)).alias("n_blocks"))


def block_of(h: Column, n_blocks: Column) -> Column:
    return F.pmod(h, n_blocks)


def blocks(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source and block: its place in the source's order, and what the last pass takes of it."""
    b = sizes.join(plan, "_key").groupBy("_key", block_of(F.col("_h"), F.col("n_blocks")).alias("_block")).agg(F.sum("size").alias("words"))
    b = b.join(plan, "_key")
    w = Window.partitionBy("_key").orderBy(unit(F.lit("block"), F.col("_key"), F.col("_block")), "_block")
    b = b.withColumns({"place": F.row_number().over(w) - 1, "before": F.sum("words").over(w) - F.col("words")})
    b = b.withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    return b.select("_key", "_block", "words", "place", "last", "passes")


def shards(b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The splitting tree: a shard for every draw (source, block, pass) of some words."""
    whole = F.when(F.col("words") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    part = F.when(F.col("last") > 0, F.array(F.col("passes"))).otherwise(F.array().cast("array<bigint>"))
    d = b.select("_key", "_block", F.explode(F.concat(whole, part)).alias("pass")).withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(unit(F.lit(level), F.col("_key"), F.col("_block"), F.col("pass")), "_key", "_block", "pass"))
        d = d.withColumns({"_p": place, "_n": F.count("*").over(node)})
        d = d.withColumn("shard", F.col("shard") * 2 + F.when(F.col("_p") * 2 > F.col("_n") + 1, 1).otherwise(0)).drop("_p", "_n")
    return d


def edges(sizes: DataFrame, plan: DataFrame, b: DataFrame) -> DataFrame:
    """Per source, the document in which its last pass ends.

    Only the documents of one block per source are looked at; rows of one id count as one here.
    """
    cut = b.filter("last > 0 and last < words").select("_key", "_block", "last")
    own = sizes.join(plan.select("_key", "n_blocks"), "_key").withColumn("_block", block_of(F.col("_h"), F.col("n_blocks"))).join(cut, ["_key", "_block"])
    own = own.groupBy("_key", "_block", "last", "_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id")).agg(F.sum("size").alias("z"))
    w = Window.partitionBy("_key").orderBy("_h", "_id")
    own = own.withColumn("before", F.sum("z").over(w) - F.col("z")).filter("before < last and before + z >= last")
    return own.select("_key", "_block", F.col("_h").alias("edge_h"), F.col("_id").alias("edge_id"), (F.col("last") - F.col("before")).alias("edge_words"), F.col("z").alias("edge_size"))


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, words of the two draws at most, and their shards."""
    sizes = store.cut(sized(docs.select("doc_id", F.col(source).alias("source"), F.col(text).alias("text"))).select("doc_id", "_key", "size", "_h"), "sizes")
    plan = store.cut(targets(sizes), "targets")
    b = store.cut(blocks(sizes, plan), "blocks")
    drawn = shards(b).groupBy("_key", "_block").agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("_shards"))  # two entries at most
    facts = b.join(drawn, ["_key", "_block"], "left").join(edges(sizes, plan, b), ["_key", "_block"], "left").join(plan.drop("passes"), "_key")
    facts = store.cut(facts, "draws")
    # Documents meet their block, not their source: a source of a third of all rows is spread over its blocks.
    d = sized(docs, text, source).join(plan.select("_key", "n_blocks"), "_key").withColumn("_block", block_of(F.col("_h"), F.col("n_blocks"))).drop("n_blocks")
    d = d.join(facts.drop("n_blocks"), ["_key", "_block"])
    mine = F.struct("_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("i"))
    edge = F.struct(F.col("edge_h").alias("_h"), F.col("edge_id").alias("i"))
    last = (
        F.when(F.col("last") >= F.col("words"), F.col("size")).when(F.col("last") <= 0, 0).when(mine < edge, F.col("size"))
        .when(mine == edge, F.floor(F.col("size") * F.col("edge_words") / F.col("edge_size"))).otherwise(0).cast("long")
    )
    d = d.withColumn("last_words", F.when(F.col("words") > 0, last).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("taken", F.col("passes") * F.col("size") + F.col("last_words"))
    return d.drop("_key", "_block", "words", "place", "last", "rest", "edge_h", "edge_id", "edge_words", "edge_size")


def rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document and draw, ordered by chance within its shard; every draw is of the whole text.

    The document in which a source's last pass ends is in that pass if at least half of its words are.
    """
    d = mixed.withColumn("last_words", F.when(F.col("last_words") * 2 >= F.col("size"), F.col("size")).otherwise(0))
    n = F.col("passes") + F.when(F.col("last_words") > 0, 1).otherwise(0)
    d = d.filter((F.col("size") > 0) & (n > 0)).withColumn("_pass", F.explode(F.sequence(F.lit(0), n - 1)))
    d = d.withColumns({"_shard": F.element_at("_shards", F.col("_pass")), "_order": unit(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_pass"))})
    return d.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order").select(*columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row per document and draw.

    Rows without an id are told apart by their text.
    """
    own, names = store.hidden(docs, "doc_id", "source", "text")
    own = own.withColumns({"_given": F.col("doc_id"), "doc_id": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5("text")))})
    return rows(mix(own), own.columns).withColumn("doc_id", F.col("_given")).select(*names)


def sql() -> str:
    """What ``op10_mixing`` says, for a checking engine: sizes, level, blocks, tree and edge."""
    u = lambda *parts: "('0x' || substr(md5(concat_ws('|', 'mix', " + ", ".join(f"cast({p} as varchar)" for p in parts) + ")), 1, 13))::BIGINT"
    tree, last = [], "draws"
    for level in range(4):
        tree.append(
            f"p{level} AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {u(str(level), 'k', 'block', 'pass')}, k, block, pass) AS p, count(*) OVER (PARTITION BY shard) AS n FROM {last}),"
            f" t{level} AS (SELECT k, block, pass, shard * 2 + CASE WHEN p * 2 > n + 1 THEN 1 ELSE 0 END AS shard FROM p{level})"
        )
        last = f"t{level}"
    return f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 'z') AS k, coalesce(cast(doc_id AS varchar), 'null') AS id,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, {u("'doc'", "coalesce(cast(doc_id AS varchar), 'null')")} AS h FROM documents),
s0 AS (SELECT k, cast(sum(size) AS BIGINT) AS s FROM d GROUP BY k),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 2.0::DOUBLE * s AS most FROM s0),
s2 AS (SELECT *, most / w AS ratio, 1.5::DOUBLE * (SELECT cast(sum(s) AS BIGINT) FROM s0) AS total, sum(w) OVER () AS wall,
    sum(most) OVER o - most AS c, sum(w) OVER o - w AS cw FROM s1 WINDOW o AS (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s3 AS (SELECT *, max(CASE WHEN (total - c) / (wall - cw) <= ratio THEN (total - c) / (wall - cw) END) OVER () AS level FROM s2),
s4 AS (SELECT k, s, least(most, coalesce(level * w, most)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN s > 0 THEN cast(floor(target / s) AS BIGINT) ELSE 0 END AS passes, greatest(1, least(4096, cast(ceil(s / 5000.0) AS BIGINT))) AS nb FROM s4),
plan AS (SELECT *, cast(floor(target - passes * s) AS BIGINT) AS rest FROM s5),
db AS (SELECT d.*, plan.s, plan.target, plan.passes, plan.rest, h % nb AS block FROM d JOIN plan USING (k)),
b0 AS (SELECT k, block, passes, rest, cast(sum(size) AS BIGINT) AS words FROM db GROUP BY ALL),
b1 AS (SELECT *, cast(sum(words) OVER (PARTITION BY k ORDER BY {u("'block'", 'k', 'block')}, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - words AS before FROM b0),
b AS (SELECT *, greatest(0, least(words, rest - before)) AS last FROM b1),
draws AS (SELECT k, block, unnest(range(0, passes)) AS pass, 0 AS shard FROM b WHERE words > 0 UNION ALL SELECT k, block, passes, 0 FROM b WHERE last > 0),
{', '.join(tree)},
e0 AS (SELECT db.k, db.block, b.last, h, id, cast(sum(size) AS BIGINT) AS z FROM db JOIN b USING (k, block) WHERE b.last > 0 AND b.last < b.words GROUP BY ALL),
e1 AS (SELECT *, cast(sum(z) OVER (PARTITION BY k ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - z AS before FROM e0),
e AS (SELECT k, block, h AS eh, id AS eid, last - before AS ew, z AS ez FROM e1 WHERE before < last AND before + z >= last)
SELECT doc_id, size, s AS source_size, target, db.passes * size + CASE WHEN b.words = 0 THEN 0 WHEN b.last >= b.words THEN size WHEN b.last <= 0 THEN 0
    WHEN h < eh OR (h = eh AND id < eid) THEN size WHEN h = eh AND id = eid THEN cast(floor(size * ew / ez) AS BIGINT) ELSE 0 END AS taken,
    x.shard AS shard_1, y.shard AS shard_2
FROM db JOIN b USING (k, block) LEFT JOIN e USING (k, block) LEFT JOIN {last} x ON x.k = db.k AND x.block = db.block AND x.pass = 0
LEFT JOIN {last} y ON y.k = db.k AND y.block = db.block AND y.pass = 1"""


@query("op10_mixing", sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mix(docs)
    shard = lambda p: F.element_at("_shards", F.lit(p).cast("long")).alias(f"shard_{p + 1}")
    return m.select("doc_id", "size", "source_size", "target", "taken", shard(0), shard(1))

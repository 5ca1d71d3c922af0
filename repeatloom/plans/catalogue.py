"""Named queries over the driver's tables, with DuckDB SQL for those that SQL can express.

The DNA view of `documents` is the base relation; the units are the distinct part names, the templates the distinct market
segments, both mapped to bases too. Queries read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.config import Config
from repeatloom.functions import dna
from repeatloom.operators import arrays, extract, intervals, period, units, windows
from repeatloom.plans import annotate, arrays_plan
from repeatloom.sources import fasta, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W, K, LOW = 200, 10, 90.0

_DNA = """dna AS (SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtan') AS seq FROM documents),
sequences AS (SELECT seq_id, seq, length(seq) AS length FROM dna)"""
_TILES = _DNA + """, tiles AS (SELECT seq_id, length, seq, CAST(i AS BIGINT) AS win_idx, CAST(i * 200 + 1 AS BIGINT) AS "start", CAST(i * 200 + 200 AS BIGINT) AS "end", substr(seq, i * 200 + 1, 200) AS win
  FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((length - 200) / 200.0) AS BIGINT)))) AS i FROM sequences WHERE length >= 200))"""
_TOTALS = _TILES + """, hits AS (SELECT seq_id, win_idx, substr(win, CAST(j AS BIGINT), 10) AS kmer FROM (SELECT *, unnest(range(1, length(win) - 10 + 1)) AS j FROM tiles)),
counts AS (SELECT seq_id, win_idx, kmer, count(*) AS c FROM hits WHERE kmer NOT LIKE '%n%' GROUP BY ALL),
sums AS (SELECT seq_id, win_idx, sum(c) AS total, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS singles FROM counts GROUP BY ALL),
totals AS (SELECT t.seq_id, t.win_idx, t.length, t."start", t."end", CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(singles, 0) AS BIGINT) AS singles FROM tiles t LEFT JOIN sums USING (seq_id, win_idx)),
scores AS (SELECT *, CASE WHEN total < 20 THEN 100.0 ELSE CAST(singles AS DOUBLE) * 100.0 / total END AS score FROM totals)"""
_REGIONS = "WITH RECURSIVE " + _TOTALS + """, hit AS (SELECT *, max(win_idx) OVER (PARTITION BY seq_id) AS last FROM scores),
low AS (SELECT *, CASE WHEN win_idx = last THEN length ELSE least("start" + 399, length) END AS reach, win_idx - lag(win_idx) OVER (PARTITION BY seq_id ORDER BY win_idx) AS step FROM hit WHERE score < 90),
isl AS (SELECT *, sum(CASE WHEN step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY win_idx) AS island FROM low),
num AS (SELECT *, row_number() OVER (PARTITION BY seq_id, island ORDER BY win_idx) AS r FROM isl),
fold AS (SELECT seq_id, island, r, "start", reach, CAST(score AS DOUBLE) AS score FROM num WHERE r = 1
  UNION ALL SELECT n.seq_id, n.island, n.r, f."start", n.reach, (f.score * (f.reach - f."start") + n.score * (n.reach - n."start")) / ((f.reach - f."start") + (n.reach - n."start")) FROM fold f JOIN num n ON n.seq_id = f.seq_id AND n.island = f.island AND n.r = f.r + 1),
regions AS (SELECT seq_id, "start", reach AS "end", score, r AS windows FROM (SELECT *, max(r) OVER (PARTITION BY seq_id, island) AS m FROM fold) WHERE r = m)"""
_POS = _DNA + """, pos AS (SELECT seq_id, kmer, pos FROM (SELECT seq_id, substr(seq, CAST(pos AS BIGINT), 10) AS kmer, CAST(pos AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, length - 10 + 1)) AS pos FROM sequences)) WHERE kmer NOT LIKE '%n%')"""
_DIST = _POS + """, dist AS (SELECT * FROM (SELECT *, lead(pos) OVER (PARTITION BY seq_id, kmer ORDER BY pos) - pos AS dist FROM pos) WHERE dist BETWEEN 7 AND 1000)"""
_MODE = _DIST + """, wind AS (SELECT seq_id, dist, CAST(least(greatest(1, floor((length - 101) / 100.0) + 1) - 1, greatest(0, ceil((pos - 1000) / 100.0))) AS BIGINT) AS win FROM dist JOIN sequences USING (seq_id)),
cnt AS (SELECT seq_id, win, dist, count(*) AS n FROM wind GROUP BY ALL),
modes AS (SELECT seq_id, win, CAST(pairs AS BIGINT) AS pairs, dist AS period FROM (SELECT *, sum(n) OVER (PARTITION BY seq_id, win) AS pairs, row_number() OVER (PARTITION BY seq_id, win ORDER BY n DESC, dist) AS rk FROM cnt) WHERE rk = 1 AND pairs > 10)"""
_RUNS = _MODE + """, pc AS (SELECT seq_id, period, count(*) AS n FROM modes GROUP BY ALL),
pr AS (SELECT *, period - row_number() OVER (PARTITION BY seq_id ORDER BY period) AS run FROM pc),
runs AS (SELECT seq_id, min(period) AS first_period, string_agg(CAST(period AS VARCHAR), ',' ORDER BY period) AS names, CAST(sum(n) AS BIGINT) AS n, CAST(floor(avg(period)) AS BIGINT) AS mean_period FROM pr GROUP BY seq_id, run)"""
_UNITS = """units AS (SELECT min(p_partkey) AS unit_id, seq, length(seq) AS length FROM (SELECT p_partkey, translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtan') AS seq FROM part) GROUP BY seq),
templates AS (SELECT name, seq, length(seq) AS length FROM (SELECT DISTINCT c_mktsegment AS name, translate(regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtan') AS seq FROM customer))"""
_RC = "reverse(translate({0}, 'acgtn', 'tgcan'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def spread(df: DataFrame) -> DataFrame:
    """Few large files are dealt to all cores; a table that is read in enough partitions already is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), dna.from_text(F.col("text")).alias("seq")).withColumn("length", F.length("seq").cast("long"))


def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy(dna.from_text(F.col("p_name")).alias("seq")).agg(F.min("p_partkey").alias("unit_id"))


def template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("seq", dna.from_text(F.col("name"))).withColumn("place", F.col("name"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.singleton_score(windows.kmer_totals(sequences(spark, sf_dir), W, K), K)


def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.regions(scores(spark, sf_dir), W, LOW)


@query("WITH " + _DNA + " SELECT count(*) AS records, CAST(sum(length) AS BIGINT) AS total, max(length) AS longest, min(length) AS shortest FROM sequences")
def seq_summary(spark, sf_dir):
    return sequences(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("total"), F.max("length").alias("longest"), F.min("length").alias("shortest"))


@query("WITH " + _DNA + " SELECT seq_id, length FROM sequences ORDER BY length DESC, seq_id LIMIT 10")
def seq_top10_length(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", "length").orderBy(F.col("length").desc(), "seq_id").limit(10)


@query("SELECT doc_id AS num_id, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN source || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) ELSE source END AS seq_id FROM documents")
def dedup_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("num_id"), F.col("source").alias("name"))
    return fasta.unique_names(docs).select("num_id", "seq_id")


@query("WITH " + _DNA + " SELECT seq_id, md5(" + _RC.format("seq") + ") AS rc_md5 FROM sequences")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.md5(dna.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


@query("WITH " + _DNA + " SELECT seq_id, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS {b}" for b in "acgtn") + " FROM sequences")
def base_composition(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", *[dna.count_of(F.col("seq"), b).alias(b) for b in "acgtn"])


@query("WITH " + _UNITS + " SELECT unit_id, kmer, count(*) AS n FROM (SELECT unit_id, substr(repeat(seq, 3), CAST(i AS BIGINT), 5) AS kmer FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units)) GROUP BY ALL")
def circular_kmers(spark, sf_dir):
    u = unit_table(spark, sf_dir)
    return u.select("unit_id", F.explode(dna.circular_kmers(F.col("seq"), 5)).alias("kmer")).groupBy("unit_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _UNITS + " SELECT unit_id, min(substr(seq || seq, CAST(i AS BIGINT), length)) AS least FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units) GROUP BY unit_id")
def lex_min_rotation(spark, sf_dir):
    return unit_table(spark, sf_dir).select("unit_id", dna.least_rotation(F.col("seq")).alias("least"))


@query("WITH " + _TILES + ' SELECT seq_id, win_idx, "start", "end" FROM tiles')
def tumbling_windows(spark, sf_dir):
    return windows.tiles(sequences(spark, sf_dir), W).select("seq_id", "win_idx", "start", "end")


@query("WITH " + _TOTALS + " SELECT seq_id, win_idx, total, singles FROM totals")
def kmer_counts(spark, sf_dir):
    return windows.kmer_totals(sequences(spark, sf_dir), W, K).select("seq_id", "win_idx", "total", "singles")


@query("WITH " + _TOTALS + " SELECT seq_id, win_idx, round(score, 6) AS score FROM scores")
def singleton_ratio(spark, sf_dir):
    return scores(spark, sf_dir).select("seq_id", "win_idx", F.round("score", 6).alias("score"))


@query(_REGIONS + ' SELECT seq_id, "start", "end", round(score, 6) AS score, windows FROM regions')
def repeat_regions(spark, sf_dir):
    return region_table(spark, sf_dir).select("seq_id", "start", "end", F.round("score", 6).alias("score"), "windows")


@query(_REGIONS + ', total AS (SELECT sum(length) AS bases FROM sequences) SELECT count(*) AS regions, CAST(coalesce(sum("end" - "start" + 1), 0) AS BIGINT) AS covered, round(100.0 * coalesce(sum("end" - "start" + 1), 0) / max(bases), 6) AS pct FROM regions, total')
def region_coverage_pct(spark, sf_dir):
    bases = sequences(spark, sf_dir).agg(F.sum("length").alias("bases"))
    found = region_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("regions"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("covered"))
    return found.join(F.broadcast(bases)).select("regions", "covered", F.round(F.col("covered") * 100.0 / F.col("bases"), 6).alias("pct"))  # one row each


@query("WITH " + _POS + " SELECT seq_id, kmer, count(*) AS n, min(pos) AS first, max(pos) AS last FROM pos GROUP BY ALL HAVING count(*) >= 2")
def kmer_positions(spark, sf_dir):
    return period.kmer_counts(sequences(spark, sf_dir), K)


def _distances(spark, sf_dir):
    return period.distances(sequences(spark, sf_dir), K, 7, 1000)


@query("WITH " + _DIST + " SELECT seq_id, kmer, pos, dist FROM dist")
def kmer_distances(spark, sf_dir):
    return _distances(spark, sf_dir)


@query("WITH " + _DIST + " SELECT seq_id, dist, count(*) AS n FROM dist GROUP BY ALL")
def distance_histogram(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("seq_id", "dist").agg(F.count(F.lit(1)).alias("n"))


def _modes(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return period.moving_mode(period.distance_windows(_distances(spark, sf_dir), s))


@query("WITH " + _MODE + " SELECT * FROM modes")
def moving_mode(spark, sf_dir):
    return _modes(spark, sf_dir)


@query("WITH " + _RUNS + " SELECT seq_id, first_period, names, n, mean_period FROM runs")
def period_runs(spark, sf_dir):
    return period.period_runs(_modes(spark, sf_dir))


@query("WITH " + _RUNS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, first_period) AS rk FROM runs)
SELECT seq_id, max(CASE WHEN rk = 1 THEN mean_period END) AS top_n, string_agg('N_' || names || '_Count_' || n || '.', '' ORDER BY rk) AS top_5 FROM ranked WHERE rk <= 5 GROUP BY seq_id""")
def top5_periods(spark, sf_dir):
    return period.top_periods(period.period_runs(_modes(spark, sf_dir)))


@query("WITH " + _POS + """, kc AS (SELECT seq_id, kmer, count(*) AS n FROM pos GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT kc.*, floor(count(*) OVER (PARTITION BY seq_id) / 1000.0) + 1 AS need, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, kmer) AS rk, count(*) OVER (PARTITION BY seq_id) AS total, max(n) OVER (PARTITION BY seq_id) AS most FROM kc)
SELECT seq_id, kmer, n, rk AS rank FROM t WHERE need <= 2 OR CASE WHEN most >= need THEN n >= need AND rk <= 5000 ELSE rk <= ceil(total / 10.0) END""")
def frequency_filter_topk(spark, sf_dir):
    return period.frequent_kmers(period.kmer_counts(sequences(spark, sf_dir), K))


@query("WITH " + _UNITS + " SELECT a.unit_id AS a, b.unit_id AS b, CAST(hamming(a.seq, b.seq) AS BIGINT) AS mismatches FROM units a JOIN units b ON a.length = b.length AND a.unit_id < b.unit_id WHERE hamming(a.seq, b.seq) <= 4")
def hamming_pairs(spark, sf_dir):
    return units.hamming_pairs(unit_table(spark, sf_dir), 4)


@query("WITH " + _DNA + ", w AS (SELECT seq_id, CAST(i AS BIGINT) AS pos, hamming(substr(seq, CAST(i AS BIGINT), 12), 'acgtacgatcga') AS m FROM (SELECT *, unnest(range(1, length - 12 + 2)) AS i FROM sequences WHERE length >= 12)) SELECT seq_id, pos, CAST(m AS BIGINT) AS mismatches FROM w WHERE m <= 2")
def hamming_pattern_scan(spark, sf_dir):
    return units.pattern_hits(sequences(spark, sf_dir), "acgtacgatcga", 2)


@query("WITH " + _UNITS + " SELECT u.unit_id, t.name, CAST(levenshtein(u.seq, t.seq) AS BIGINT) AS distance FROM units u JOIN templates t ON t.length BETWEEN floor(u.length * 0.85) AND ceil(u.length * 1.15)")
def levenshtein_gate(spark, sf_dir):
    return units.gated_distances(unit_table(spark, sf_dir), template_table(spark, sf_dir), 0.15)


@query("WITH " + _UNITS + ", turns AS (SELECT unit_id, length, CAST(i AS BIGINT) AS i, substr(seq || seq, CAST(i + 1 AS BIGINT), length) AS turn FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units)"
       " UNION ALL SELECT unit_id, length, CAST(i + length AS BIGINT), " + _RC.format("substr(seq || seq, CAST(i + 1 AS BIGINT), length)") + " FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units)),"
       " d AS (SELECT unit_id, name, i, levenshtein(turn, t.seq) AS dist, greatest(turns.length, t.length) AS l FROM turns JOIN templates t ON turns.length BETWEEN floor(t.length * 0.85) AND ceil(t.length * 1.15)),"
       " b AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY CAST(dist AS DOUBLE) / l, name, i) AS rk FROM d) SELECT unit_id, name, i AS rotation, round(CAST(dist AS DOUBLE) / l, 6) AS score FROM b WHERE rk = 1")
def template_best_match(spark, sf_dir):
    return units.best_template(unit_table(spark, sf_dir), template_table(spark, sf_dir), 0.15).select("unit_id", "name", "rotation", F.round("score", 6).alias("score"))


@query("WITH " + _UNITS + ", k AS (SELECT unit_id, length, substr(repeat(seq, 3), CAST(i AS BIGINT), 4) AS kmer FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units)),"
       " dk AS (SELECT DISTINCT unit_id, length, kmer FROM k) SELECT a.unit_id AS a, b.unit_id AS b, count(*) AS covered FROM k a JOIN dk b ON a.kmer = b.kmer AND a.unit_id <> b.unit_id AND b.length BETWEEN floor(a.length * 0.85) AND ceil(a.length * 1.15) GROUP BY ALL")
def kmer_coverage_pairs(spark, sf_dir):
    return units.coverage_pairs(unit_table(spark, sf_dir), 4, 0.15)


@query(_REGIONS + ', v AS (SELECT *, ("end" - "start") * CASE WHEN score = 0 THEN 1.0 ELSE score END AS importance FROM regions) SELECT seq_id, "start", round(importance, 4) AS importance, row_number() OVER (PARTITION BY seq_id ORDER BY importance DESC, "start") AS rank FROM v')
def importance_rank(spark, sf_dir):
    return intervals.importance(region_table(spark, sf_dir)).select("seq_id", "start", F.round("importance", 4).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT l_suppkey, l_quantity AS mode FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS rk FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE rk = 1")
def mode_smallest(spark, sf_dir):
    return intervals.smallest_mode(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_quantity")


@query("WITH t AS (SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 16 + l_linenumber) AS i FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM t WHERE n <= 10 OR list_contains(list_transform(range(10), lambda k: CAST(round_even(1 + k * ((n - 1) / 9.0), 0) AS BIGINT)), i)")
def even_sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("place"))
    return intervals.even_sample(rows, 10, "l_suppkey", "place").drop("place")


@query("WITH " + _UNITS + ", c AS (SELECT length, CAST(i AS BIGINT) AS col, substr(seq, CAST(i AS BIGINT), 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM units) GROUP BY ALL),"
       " r AS (SELECT *, row_number() OVER (PARTITION BY length, col ORDER BY n DESC, strpos('gcta', base)) AS rk FROM c WHERE base IN ('a', 'c', 'g', 't')) SELECT length, string_agg(base, '' ORDER BY col) AS consensus FROM r WHERE rk = 1 GROUP BY length")
def column_consensus(spark, sf_dir):
    return units.consensus_by(unit_table(spark, sf_dir).withColumn("length", F.length("seq").cast("long")), "length")


_HITS = _POS + """, iv AS (SELECT seq_id, pos AS "start", pos + 9 AS "end" FROM pos WHERE kmer LIKE 'a%t'),
nb AS (SELECT *, lead("start") OVER (PARTITION BY seq_id ORDER BY "start", "end") AS after, lag("end") OVER (PARTITION BY seq_id ORDER BY "start", "end") AS before, avg("end" - "start" + 1) OVER (PARTITION BY seq_id) AS mw FROM iv)"""


def _hits(spark, sf_dir):
    return period.kmer_intervals(sequences(spark, sf_dir), K, begins="a", ends="t")


@query("WITH " + _HITS + ' SELECT seq_id, "start", "end", greatest(0, "end" - after + 1) AS overlap, greatest(0, after - "end" - 1) AS gap FROM nb WHERE after IS NOT NULL')
def neighbour_relations(spark, sf_dir):
    return intervals.neighbours(_hits(spark, sf_dir)).where("after is not null").drop("before", "after", "mean_width")


@query("WITH " + _HITS + ' SELECT seq_id, "end" + 1 AS "start", after - 1 AS "end" FROM nb WHERE after IS NOT NULL AND greatest(0, after - "end" - 1) BETWEEN floor(round_even(mw, 0) * 0.5) AND ceil(round_even(mw, 0) * 1.5)')
def gap_fill_candidates(spark, sf_dir):
    return intervals.gap_candidates(_hits(spark, sf_dir))


@query("WITH " + _HITS + ' SELECT seq_id, "start", "end", coalesce("start" - before > mw, true) AS left_edge, coalesce(after - "end" > mw, true) AS right_edge FROM nb')
def edge_flags(spark, sf_dir):
    return intervals.edge_flags(_hits(spark, sf_dir)).drop("before", "after", "mean_width")


@query("SELECT o_orderkey, count(l_quantity) AS repeats_number, CAST(coalesce(ceil(quantile_cont(l_quantity, 0.5)), 0) AS BIGINT) AS median_width, CAST(coalesce(ceil(quantile_cont(l_extendedprice, 0.5)), -1) AS BIGINT) AS median_score FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def array_summary(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("score"))
    return arrays_plan.counts_and_medians(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), rows, "o_orderkey")


@query(_REGIONS + ", own AS (SELECT DISTINCT seq_id FROM regions) SELECT s.seq_id, (o.seq_id IS NOT NULL) AS repetitive FROM sequences s LEFT JOIN own o ON s.seq_id = o.seq_id")
def semi_anti_split(spark, sf_dir):
    s, r = sequences(spark, sf_dir).select("seq_id"), region_table(spark, sf_dir).select("seq_id")
    return s.join(r, "seq_id", "left_semi").withColumn("repetitive", F.lit(True)).unionByName(s.join(r, "seq_id", "left_anti").withColumn("repetitive", F.lit(False)))


@query(_REGIONS + """ SELECT CAST(seq_id AS VARCHAR) || chr(9) || 'windows' || chr(9) || 'region' || chr(9) || "start" || chr(9) || "end" || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'ID=' || seq_id || '_' || "start" || ';Windows=' || windows AS line FROM regions""")
def gff_lines(spark, sf_dir):
    r = region_table(spark, sf_dir)
    name = F.concat(F.col("seq_id").cast("string"), F.lit("_"), F.col("start").cast("string"))
    return sinks.gff(r, seqid="seq_id", source=F.lit("windows"), type_=F.lit("region"), start="start", end="end", attributes=[("ID=", name), ("Windows=", F.col("windows"))])


@query(_REGIONS + """ SELECT CAST("start" AS VARCHAR) || ',' || "end" || ',' || '"' || seq_id || '"' || ',' || windows AS line FROM regions""")
def csv_lines(spark, sf_dir):
    return sinks.csv(region_table(spark, sf_dir).select("start", "end", F.col("seq_id").cast("string").alias("seq_id"), "windows"))


def _written(spark, sf_dir, save) -> DataFrame:
    """The DNA view as a table: each step reads it, none makes it again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return save(dna.view(docs, "doc_id", "text").withColumns({"length": F.length("seq").cast("long"), "num_id": F.col("seq_id")}))


def _annotation(spark, sf_dir):
    s = _written(spark, sf_dir, annotate.saver(spark))
    return annotate.annotate(s, RANGES[-1], shorter=RANGES[:-1])


#: Windows of 121, 200 and 1111 bases: most documents hold no window of the default, and short arrays are thin in a long one.
RANGES = (Config(max_repeat=100), Config(max_repeat=172), Config())


@query()
def split_arrays(spark, sf_dir):
    """Regions of the DNA view, segmented, with period and representative."""
    save = annotate.saver(spark)
    s = _written(spark, sf_dir, save)
    return annotate.find(s, save(extract.pieces(s)), RANGES, save)[1]


@query()
def canonical_units(spark, sf_dir):
    u = unit_table(spark, sf_dir).select(F.col("unit_id").alias("start"), F.col("seq").alias("representative"))
    return arrays.canonicalise(u, RANGES[-1], template_table(spark, sf_dir))


@query()
def greedy_classes(spark, sf_dir):
    u = unit_table(spark, sf_dir).select(F.col("unit_id").alias("id"), "seq", F.length("seq").cast("double").alias("importance"))
    return arrays.greedy_classes(u, Config(class_k=4), annotate.saver(spark)).drop("seed_seq")


@query()
def full_pipeline(spark, sf_dir):
    """Summary of all classified arrays of the DNA view, after mapping every repeat."""
    return _annotation(spark, sf_dir).summary


@query()
def mapped_repeats(spark, sf_dir):
    out = _annotation(spark, sf_dir)
    return arrays.with_sequence(out.repeats, out.pieces)

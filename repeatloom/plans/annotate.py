"""The whole annotation: sequences to regions, arrays, classes, repeats and summaries, as tables and as files."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.config import REPEATS, SUMMARY, Config, columns
from repeatloom.operators import arrays as ops
from repeatloom.operators import extract, windows
from repeatloom.plans import arrays_plan, report
from repeatloom.sources import fasta, sinks


def saver(spark: SparkSession):
    """save(df): writes a table to the shared folder (spark.checkpoint.dir; a temporary one only in local mode) and reads it back."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or tempfile.mkdtemp(prefix="repeatloom-")

    def save(df: DataFrame) -> DataFrame:
        path = f"{top.rstrip('/')}/annotate/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


@dataclass
class Annotation:
    regions: DataFrame
    found: DataFrame  # arrays as they were cut, before any turn
    arrays: DataFrame  # all arrays with class and number
    repeats: DataFrame  # with the representative of their array
    summary: DataFrame
    sequences: DataFrame
    pieces: DataFrame


def find(sequences: DataFrame, pieces: DataFrame, ranges: tuple[Config, ...], save) -> tuple[DataFrame, DataFrame]:
    """Regions and arrays of each configuration, in order of max_repeat. Each has its own windows and reads the sequences that
    hold one; its arrays count where their period is over the max_repeat before, so every period is looked for at one scale."""
    regions, arrays, least = None, None, None
    for cfg in ranges:
        scores = windows.singleton_score(windows.kmer_totals(sequences, cfg.window, cfg.k), cfg.k)
        own = save(windows.regions(scores, cfg.window, cfg.low_score))
        cut = ops.split_regions(own, sequences, pieces, cfg)
        if least is None:
            regions, arrays = own, cut
        else:
            regions, arrays = regions.unionByName(own), arrays.unionByName(cut.where(F.col("top_N") > least))
        least = cfg.max_repeat
    return regions, arrays


def annotate(sequences: DataFrame, cfg: Config = Config(), templates: DataFrame | None = None, shorter: tuple[Config, ...] = (), log: report.Progress | None = None) -> Annotation:
    """sequences(num_id, seq_id, seq, length). Steps that later ones read again are written once. shorter: configurations of less
    max_repeat, whose smaller windows find what cfg's windows are too long for."""
    save = saver(sequences.sparkSession)
    pieces = save(extract.pieces(sequences))
    log = log or report.Progress.silent()
    log.section("scanning windows for repeat content")
    regions, found = find(sequences, pieces, (*shorter, cfg), save)
    log.regions(regions, sequences)
    log.section("identifying arrays in repetitive regions")
    found = save(found)
    log.count(found, "candidate array")
    log.program(cfg.aligner)
    log.section("classifying arrays")
    classed = save(ops.classify(ops.canonicalise(found, cfg, templates), cfg, save))
    log.classes(classed)
    log.section("mapping repeats")
    repeats = save(ops.map_arrays(classed, sequences, pieces, cfg, templates))
    log.count(repeats, "repeat")
    log.program(cfg.mapper)
    log.program(cfg.aligner)
    return Annotation(regions, found, classed, repeats, summarise(classed, repeats), sequences, pieces)


def summarise(arrays: DataFrame, repeats: DataFrame) -> DataFrame:
    """SUMMARY: classified arrays that have repeats, with their number and medians, and the representative that the repeats were scored by."""
    r = repeats.select(F.col("arrayID").alias("array_num_ID"), "width", "score", "representative")
    unit = r.groupBy("array_num_ID").agg(F.min("representative").alias("unit"))
    t = arrays_plan.counts_and_medians(arrays.where("class != 'none_identified'"), r, "array_num_ID").where("repeats_number > 0")
    t = t.join(unit, "array_num_ID").drop("representative").withColumnsRenamed({"unit": "representative", "median_width": "median_repeat_width"})
    return t.select(*columns(SUMMARY))


def write(out: Annotation, folder: str, name: str) -> list[str]:
    """The nine tables as folders of one text file each under folder; their paths."""
    r = out.repeats.select(*columns(REPEATS))
    regions = out.regions.join(out.sequences.select("seq_id", "num_id"), "seq_id").select(
        F.col("start").alias("starts"), F.col("end").alias("ends"), F.col("score").alias("scores"), F.col("seq_id").cast("string").alias("seqID"), F.col("num_id").alias("numID")
    )
    kept, none = out.arrays.where("class != 'none_identified'"), out.arrays.where("class = 'none_identified'")
    array_notes = [("Name=", "class"), ("Array_no=", "array_num_ID"), ("Repeat_no=", "repeats_number"), ("Repeat_median_width=", "median_repeat_width")]
    array_gff = sinks.gff(out.summary.orderBy("array_num_ID"), seqid="seqID", source=F.lit("repeatloom"), type_=F.lit("Satellite_array"), start="start", end="end", attributes=array_notes)
    repeat_gff = sinks.gff(r.orderBy("arrayID", "start", "end"), seqid="seqID", source=F.lit("repeatloom"), type_=F.lit("Satellite_DNA"), start="start", end="end", score=sinks.number(F.col("score")), strand="strand", attributes=[("Name=", "class"), ("Array_no=", "arrayID")])
    tables = {
        "regarrays.csv": (regions, ["numID", "starts"]), "aregarrays.csv": (out.found, ["numID", "start"]), "classarrays.csv": (kept, ["array_num_ID"]), "no_repeats_arrays.csv": (none, ["array_num_ID"]),
        "arrays.csv": (out.summary, ["array_num_ID"]), "repeats.csv": (r, ["arrayID", "start", "end"]), "repeats_with_seq.csv": (ops.with_sequence(r, out.pieces), ["arrayID", "start", "end"]),
        "arrays.gff": (array_gff, None), "repeats.gff": (repeat_gff, None),
    }

    def one(item) -> str:
        file, (table, order) = item
        path = f"{folder}/{name}_{file}"
        sinks.write_gff(table, path) if order is None else sinks.write_csv(table, path, order)
        return path

    with ThreadPoolExecutor(4) as pool:  # independent small jobs
        return list(pool.map(one, tables.items()))


def run(spark: SparkSession, path: str, folder: str, cfg: Config = Config(), templates: str | None = None) -> Annotation | None:
    """Reads a FASTA file, writes the tables; None for a file without records. Progress goes to the log (report.py)."""
    log = report.Progress(path, folder)
    sequences = saver(spark)(fasta.sequences(spark, path))
    if sequences.isEmpty():
        log.warn(f"no record in {path}")
        return None
    log.genome(sequences)
    out = annotate(sequences, cfg, fasta.templates(spark, templates) if templates else None, log=log)
    log.files(write(out, folder, path.rstrip("/").rsplit("/", 1)[-1]))
    return out

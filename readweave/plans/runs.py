"""Whole runs, from files to files."""

from __future__ import annotations

import argparse
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from readweave import session
from readweave.config import RunConfig, run_type
from readweave.operators import evaluate, intervals, lengths, lsh, shared
from readweave.sources import store, text


class Phases:
    """Seconds of the phases of a run, in order."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.seconds = spark, {}
        self.group()

    def group(self) -> None:
        """Jobs from now on are the next phase's."""
        self.began, self.name = time.time(), f"readweave-{uuid.uuid4().hex}"
        self.spark.sparkContext.setJobGroup(self.name, "a phase of a run")

    def ended(self, name: str) -> None:
        self.seconds[name] = round(time.time() - self.began, 3)
        self.group()

    def split(self, first: str, second: str) -> None:
        """Two phases of one job: the second begins when the last stage that writes to a shuffle has ended, by the status store."""
        now, edge = time.time(), self.began
        sc = self.spark.sparkContext
        jvm, tracker = sc._jsc.sc(), sc.statusTracker()
        jvm.listenerBus().waitUntilEmpty(10_000)
        for job in tracker.getJobIdsForGroup(self.name):
            for stage in tracker.getJobInfo(job).stageIds:
                data = jvm.statusStore().lastStageAttempt(stage)
                if data.shuffleWriteBytes() and data.completionTime().isDefined():
                    edge = max(edge, data.completionTime().get().getTime() / 1000)
        edge = min(edge, now)
        self.seconds[first], self.seconds[second] = round(edge - self.began, 3), round(now - edge, 3)
        self.group()


def candidate(spark: SparkSession, files: list[str], config: RunConfig) -> DataFrame:
    return lsh.candidates(text.reads(spark, files), config)


def true(spark: SparkSession, positions: str, config: RunConfig) -> DataFrame:
    return intervals.overlap_pairs(text.positions(spark, positions, config.read_length), config.min_overlap)


def kmer(spark: SparkSession, files: list[str], config: RunConfig) -> DataFrame:
    return shared.shared_pairs(text.reads(spark, files), config.kmer, config.max_bucket)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readweave", description="Find overlapping reads.")
    p.add_argument("-t", "--run_type", required=True)
    p.add_argument("-p", "--position_file", default="")
    p.add_argument("-O", "--output_prefix", default="")
    p.add_argument("-d", "--overlap_threshold", type=int, default=20)
    p.add_argument("-B", "--block_count", type=int, default=250)
    p.add_argument("-T", "--block_size", type=int, default=3)
    p.add_argument("-M", "--max_bucket_size", type=int, default=-1)
    p.add_argument("-k", "--kmer_length", type=int, default=16)
    p.add_argument("-r", "--read_length", type=int, default=100)
    p.add_argument("-C", "--candidate_file", default="")
    p.add_argument("-R", "--true_file", default="")
    p.add_argument("-w", "--bin_width", type=int, default=100, help="width of the bins of a lengths run's histogram")
    p.add_argument("-s", "--statistics", action="store_true", help="also print counters: of each band (candidate), of pairs (kmer)")
    p.add_argument("-a", "--annotate", action="store_true", help="write candidates with both reads' positions (needs a position file)")
    p.add_argument("-S", "--store", default="", help="also keep the pairs as a store of this name, which eval runs of the session read as store:NAME")
    p.add_argument("files", nargs="*")
    return p


def configured(args: argparse.Namespace) -> RunConfig:
    return RunConfig(
        kmer=args.kmer_length, block=args.block_size, bands=args.block_count, max_bucket=args.max_bucket_size if args.max_bucket_size > 0 else None,
        min_overlap=args.overlap_threshold, read_length=args.read_length,
    )


def run_lengths(spark: SparkSession, args: argparse.Namespace, config: RunConfig, phases: Phases) -> dict:
    """The histogram of lengths (a row for each bin); the listing goes to the output."""
    if args.bin_width < 1:
        raise ValueError("the bin width must be positive")
    reads = text.reads(spark, args.files)
    phases.ended("read_files")
    if args.output_prefix:
        text.write_lengths(lengths.lengths(reads), args.output_prefix)
        phases.ended("sort_lengths")
    bins = {r["bin"]: r["n_reads"] for r in lengths.histogram(reads, args.bin_width).orderBy("bin").collect()}
    phases.ended("histogram")
    return {"reads": sum(bins.values()), "histogram": bins}


def run_eval(spark: SparkSession, args: argparse.Namespace, config: RunConfig, phases: Phases) -> dict:
    """Compare two sets of pairs, each a file or store:NAME."""
    names = (args.candidate_file, args.true_file)
    sides = [store.read(spark, n.removeprefix("store:")) if n.startswith("store:") else text.pairs(spark, n) for n in names]
    found = evaluate.evaluation(*sides, stores=all(n.startswith("store:") for n in names)).first().asDict()
    phases.ended("compare_overlaps")
    return found


def run_pairs(spark: SparkSession, args: argparse.Namespace, config: RunConfig, phases: Phases) -> dict:
    """Candidate, shared k-mer and true pairs; with a position file candidates are compared with the true pairs.

    Reads are sketched once: pairs and statistics come from one table of buckets, and reads are counted as they go by
    (a stage that runs again after a lost executor counts its reads again in ``n_reads`` alone).
    """
    kind, seen, table = args.run_type, Observation(), None
    if kind == "true":
        made = true(spark, args.position_file, config)
        phases.ended("read_files")
    else:
        reads = text.reads(spark, args.files)
        phases.ended("read_files")
        reads = reads.observe(seen, F.count(F.lit(1)).alias("n_reads"))
        table = lsh.band_buckets(reads, config) if kind == "candidate" else shared.kmer_buckets(reads, config.kmer, config.max_bucket)
        phases.split("compute_hash", "sort_records")
        made = lsh.first_bands(table, config) if kind == "candidate" else shared.counted(table)
    found = session.written(made, "pairs")
    out: dict = {"pairs": found.count()}
    phases.ended("pair_gen")
    pairs = found.select("a", "b")
    if args.output_prefix:
        if args.annotate:
            placed = intervals.annotated(pairs, text.positions(spark, args.position_file, config.read_length), config.min_overlap)
            placed.write.csv(args.output_prefix, sep=" ", header=True)
        else:
            text.write_pairs(pairs, args.output_prefix)
        phases.ended("write_output")
    if args.store:
        store.write(pairs, args.store)
        phases.ended("write_store")
    if kind == "candidate" and args.position_file:
        out |= evaluate.evaluation(pairs, true(spark, args.position_file, config)).first().asDict()
        phases.ended("compare_overlaps")
    if args.statistics and kind == "candidate":
        n_reads = F.lit(seen.get["n_reads"]).cast("long")
        out["bands"] = [r.asDict() for r in lsh.told(table, found, n_reads).orderBy("band").collect()]  # a row for each band
    if args.statistics and kind == "kmer":
        out |= shared.told(table, found).first().asDict()
    if args.statistics:
        phases.ended("statistics")
    for written in (found, table):
        session.remove(written)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run from a command line; returns what it also prints."""
    args = parser().parse_args(argv)
    kind, config = run_type(args.run_type), configured(args)
    need = {"candidate": "files", "kmer": "files", "lengths": "files", "true": "position_file"}.get(kind)
    if need and not getattr(args, need):
        raise ValueError(f"a {kind} run needs {need.replace('_', ' ')}")
    if kind == "eval" and not (args.candidate_file and args.true_file):
        raise ValueError("an eval run needs a candidate file and a true file")
    if args.annotate and not (args.position_file and args.output_prefix):
        raise ValueError("annotated pairs need a position file and an output")
    spark = spark or session.build()
    phases = Phases(spark)
    run = {"lengths": run_lengths, "eval": run_eval}.get(kind, run_pairs)
    out = {"run_type": kind} | run(spark, args, config, phases)
    out |= {"phases": phases.seconds, "seconds": round(sum(phases.seconds.values()), 3)}
    print(out)
    return out


if __name__ == "__main__":
    main()

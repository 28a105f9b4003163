"""python -m basewright.cli COMMAND [INPUT] [options]: one operator over FASTQ files.

INPUT is a file, or standard input where it is left out. Outputs are local files, compressed by their ending, or
standard output; `split`, `split2` and `barcode` write several files in one pass (a folder with a scheme, such as
hdfs://, gets a folder for each of them, written by many tasks).
"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.operators import aggregate, demux, paired, position, rowwise, sample, select
from basewright.plans import reports
from basewright.sources import fastq

LOG = logging.getLogger("basewright")
LEVELS = {1: logging.ERROR, 2: logging.WARNING, 3: logging.INFO, 4: logging.DEBUG, 5: logging.DEBUG}
CODECS = {"gzip": ".gz", "bzip2": ".bz2", "xz": ".xz"}
ENDINGS = {".gz": "gzip", ".bz2": "bzip2"}


class Job:
    """A session, the options of a command, and what commands do with both."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.o = spark, options

    def read(self, path: str | None) -> DataFrame:
        if path is None:
            path = self.o.stdin = _spooled()
        LOG.info("reads from file: %s", path)
        return fastq.read_fastq(self.spark, path)

    def pairs(self) -> DataFrame:
        return paired.zipped(self.read(self.o.read1), self.read(self.o.read2))

    def write(self, lines: DataFrame, path: str | None, header: str = "", append: bool = False) -> int:
        n = fastq.write_file(lines, path, append, self.o.compress_level, header, self.o.output_type)
        LOG.info("%d records written to %s", n, path or "standard output")
        return n

    def reads(self, made: DataFrame, path: str | None) -> int:
        return self.write(rowwise.fastq_lines(made), path)

    def text(self, text: str, path: str | None) -> str:
        with fastq.writer(path, level=self.o.compress_level, kind=self.o.output_type) as out:
            out.write(text.encode())
            out.flush()
        return text

    def ending(self) -> str:
        chosen = [ending for flag, ending in CODECS.items() if getattr(self.o, flag)]
        if len(chosen) > 1:
            raise ValueError("only one of --gzip, --bzip2 and --xz is allowed")
        return chosen[0] if chosen else ""

    def many(self, lines: DataFrame, route: str, name: Callable[[object], str]) -> dict:
        """Files by the values of `route` in the output folder."""
        ending, folder = self.ending(), self.o.outdir
        if "://" in folder:
            if ending == ".xz":
                raise ValueError("xz files are written to local folders only")
            fastq.write_routed(lines, route, folder, ENDINGS.get(ending, "none"))
            return {}
        if not os.path.isdir(folder):
            raise ValueError(f"no such folder: {folder}")
        counts = fastq.write_files(lines, route, lambda x: os.path.join(folder, f"{name(x)}.fq{ending}"), self.o.append, self.o.compress_level)
        for key, n in counts.items():
            LOG.info("%d records written to %s", n, os.path.join(folder, f"{name(key)}.fq{ending}"))
        return counts


def _spooled() -> str:
    """Standard input as a file; the codec is told by its first bytes."""
    if sys.stdin is None or sys.stdin.isatty():
        raise ValueError("no input: give a file or pipe reads to standard input")
    with tempfile.NamedTemporaryFile(prefix="basewright-", suffix=".fq", delete=False) as spool:
        shutil.copyfileobj(sys.stdin.buffer, spool)
    return spool.name


def _mate(pairs: DataFrame, m: int) -> DataFrame:
    return pairs.selectExpr("read_idx", f"id{m} AS id", f"seq{m} AS seq", f"qual{m} AS qual")


def _numbered(ordered: DataFrame) -> DataFrame:
    return position.renumbered(ordered).drop("read_idx").withColumnRenamed("rank", "read_idx")


def _concat(job: Job) -> int:
    lists = [[x.name for x in fastq.read_ids(job.spark, p).collect() if x.name.strip()] for p in (job.o.input1, job.o.input2)]  # names of files
    first, second = position.concat_lanes(*[[job.read(x.strip()) for x in names] for names in lists])
    return job.reads(first, job.o.out1) + job.reads(second, job.o.out2)


def _select(job: Job) -> int:
    one, two = select.select_pairs(job.read(job.o.read1), job.read(job.o.read2))
    counts = job.reads(one, job.o.out1), job.reads(two, job.o.out2)
    LOG.info("selected reads: %d of read1, %d of read2", *counts)
    return sum(counts)


def _mask(job: Job) -> int:
    reads = job.read(job.o.input)
    n = job.reads(rowwise.mask(reads, job.o.low_quality, job.o.char, job.o.phred), job.o.out)
    masked = rowwise.masked(reads, job.o.low_quality, job.o.phred).first()
    LOG.info("total masked bases: %d in %d reads", masked.bases, masked.reads)
    return n


def _filter(job: Job) -> int:
    tested = paired.filter_pairs(job.pairs(), job.o.n_limit, job.o.length, job.o.complexity, job.o.average_qual, job.o.phred)
    good = tested.where("passed")
    n = job.reads(_mate(good, 1), job.o.out1) + job.reads(_mate(good, 2), job.o.out2)
    LOG.info("total clean pe reads number (r1+r2): %d", n)
    if job.o.failed:
        LOG.info("total failed pe reads number (r1+r2): %d", job.reads(paired.interleaved(tested.where("NOT passed")), job.o.failed))
    return n


def _join(job: Job) -> int:
    joined = paired.join_overlap(job.pairs(), job.o.length, job.o.miss)
    n = job.reads(joined.where("overlap > 0").select("read_idx", F.col("id1").alias("id"), "seq", "qual"), job.o.out)
    rest = joined.where("overlap = 0").drop("seq", "qual")
    other = job.reads(paired.interleaved(rest), job.o.non_overlap) // 2 if job.o.non_overlap else rest.count()
    LOG.info("total pe reads number: %d", n + other)
    LOG.info("pe reads overlap rate: %.2f%%", 100 * n / max(1, n + other))
    return n


def _search(job: Job) -> int:
    n = job.reads(select.search(job.read(job.o.input), job.o.pattern, job.o.ignore_case, job.o.invert_match), job.o.out)
    LOG.info("total reads matched number: %d", n)
    return n


def _grep(job: Job) -> int:
    names = fastq.read_ids(job.spark, job.o.id_list)
    if not names.limit(1).count():
        raise ValueError(f"no names in {job.o.id_list}")
    n = job.reads(select.grep(job.read(job.o.input), names, job.o.full_name), job.o.out)
    LOG.info("total reads matched number: %d", n)
    return n


def _remove(job: Job) -> int:
    kept, gone = select.remove(job.read(job.o.input), fastq.read_ids(job.spark, job.o.name))
    if not job.o.remove:
        job.reads(gone, job.o.save)
    return job.reads(kept, job.o.out)


def _stats(job: Job) -> str:
    reads = job.read(job.o.input)
    text = reports.summary_text(aggregate.summary(reads, job.o.phred))
    with fastq.writer(job.o.sumy, level=job.o.compress_level) as out:
        out.write(text.encode())
    job.text(reports.cycle_text(aggregate.cycle_bases(reads), aggregate.cycle_qualities(reads, job.o.phred)), job.o.cycle)
    return text


def _kmer(job: Job) -> int:
    counts = aggregate.kmers(job.read(job.o.input), job.o.kmer_size)
    lines = counts.select(F.col("kmer").alias("read_idx"), F.concat_ws("\t", "kmer", F.col("n").cast("string")).alias("value"))
    return job.write(lines, job.o.out, "kmer\tcount" if job.o.header else "")


def _sort(job: Job) -> int:
    keys = [k for k in ("name", "seq", "gc", "length") if getattr(job.o, f"sort_by_{k}")]
    if len(keys) != 1:
        raise ValueError("choose one key to sort by")
    return job.reads(_numbered(position.sort_reads(job.read(job.o.input), keys[0], job.o.reverse)), job.o.out)


def _slide(job: Job) -> int:
    made = rowwise.slide(job.read(job.o.input), job.o.window, job.o.step, job.o.suffidx)
    return job.write(made.select(F.struct("read_idx", "part").alias("read_idx"), rowwise.fastq_line().alias("value")), job.o.out)


def _fq2sam(job: Job) -> int:
    made = rowwise.to_sam(job.read(job.o.read1), job.read(job.o.read2) if job.o.read2 else None, job.o.read_group_name)
    header = rowwise.sam_header(job.o.sample_name, job.o.read_group_name, job.o.library_name, job.o.platform)
    return job.write(made.select(F.struct("read_idx", "mate").alias("read_idx"), "value"), job.o.out, header)


def _barcode(job: Job) -> dict:
    listed = fastq.read_barcodes(job.spark, job.o.barcode)
    if not listed:
        raise ValueError(f"no barcodes in {job.o.barcode}")
    pairs = job.pairs()
    made = demux.demultiplex(pairs, listed, job.o.mode, job.o.error, job.o.rev_comp)
    parts = [("1", "id1", "seq1", "qual1"), ("2", "id2", "seq2", "qual2"), ("barcode", "id2", "barcode_seq", "barcode_qual")]
    each = [F.struct(F.concat_ws("_", "sample", F.lit(name)).alias("route"), F.col(i).alias("id"), F.col(s).alias("seq"), F.col(q).alias("qual")) for name, i, s, q in parts]
    rows = made.select("read_idx", F.inline(F.array(*each)))
    lines = rows.select("read_idx", "route", rowwise.fastq_line().alias("value"))
    counts = job.many(lines, "route", str)
    LOG.info("data split rate: %.4f%%", 100 * sum(n for k, n in counts.items() if k.endswith("_1")) / max(1, pairs.count()))
    return counts


def _split(job: Job) -> dict:
    reads = job.read(job.o.input)
    lines = rowwise.fastq_lines(reads).withColumn("mate", (F.col("read_idx") % 2 + 1).cast("int"))
    return job.many(lines, "mate", lambda m: f"{job.o.prefix}_r{m}")


def _split2(job: Job) -> dict:
    lines = rowwise.fastq_lines(job.read(job.o.input))
    counts = job.many(position.split_chunks(lines, job.o.num), "chunk", lambda k: f"{job.o.prefix}{k}")
    LOG.info("total chunk number is: %d", len(counts))
    return counts


def _plot(job: Job) -> str:
    series = reports.read_cycles(job.spark, job.o.data)
    return _figure(job, series, "Bases by place (%)", 1)


def _gcplot(job: Job) -> str:
    reports.check_figure(job.o.types, job.o.ylim)
    histogram = aggregate.gc_histogram(job.read(job.o.input)).orderBy("gc").collect()  # 101 rows
    job.text(reports.gc_text(histogram), job.o.out)
    return _figure(job, {"reads": [x.ratio for x in histogram]}, "Reads by GC content (%)", 0)


def _figure(job: Job, series: dict[str, list[float]], title: str, first: int) -> str:
    path = f"{job.o.prefix}.{reports.check_figure(job.o.types, job.o.ylim)}"
    figure = reports.figure(series, job.o.types, job.o.width, job.o.height, job.o.ylim, title, first)
    with open(path, "wb") as out:
        out.write(figure)
    if job.o.show_terminal:
        sys.stdout.write(reports.terminal_chart(series, job.o.ylim))
    return path


def _view(job: Job) -> int:
    """Pages until the end, or until q is typed."""
    reads, shown, page = job.read(job.o.input), 0, 0
    height = shutil.get_terminal_size().lines
    with fastq.writer(job.o.out, level=job.o.compress_level, kind=job.o.output_type) as out:
        while rows := rowwise.fastq_lines(position.page(reads, page, height)).orderBy("read_idx").collect():
            out.write("".join(f"{x.value}\n" for x in rows).encode())
            out.flush()
            page, first, shown = page + 1, shown + 1, shown + len(rows)
            print(f"Page: {page}, reads from {first} to {shown}, press enter to show next page, q and enter to quit: ", end="", file=sys.stderr)
            if job.o.input and sys.stdin.readline().strip() == "q":
                return shown
    print("End of file!", file=sys.stderr)
    return shown


def _one(f: Callable, *names: str) -> Callable[[Job], int]:
    """A command that makes reads of reads, by options of these names in the order of f's arguments."""
    return lambda job: job.reads(f(job.read(job.o.input), *(getattr(job.o, n) for n in names)), job.o.out)


def _lines(f: Callable) -> Callable[[Job], int]:
    return lambda job: job.write(f(job.read(job.o.input), job.o), job.o.out)


def _report(f: Callable) -> Callable[[Job], str]:
    return lambda job: job.text(f(job.read(job.o.input), job.o), job.o.out)


#: What options take: a whole number, a number, a text, a needed text, or nothing (a flag).
_INT, _FLOAT = (lambda d: {"type": int, "default": d}), (lambda d: {"type": float, "default": d})
_STR, _FLAG = (lambda d=None: {"default": d}), {"action": "store_true"}
_NEED, _NEED_INT = {"required": True}, {"type": int, "required": True}
_IN, _OUT = {"nargs": "?"}, ("-o --out", _STR())
_MATES = ("-1 --read1", _NEED), ("-2 --read2", _NEED)
_TWO = ("-f --out1", _NEED), ("-r --out2", _NEED)
_PACK = ("-z --gzip", _FLAG), ("-Z --bzip2", _FLAG), ("-x --xz", _FLAG), ("--append", _FLAG), ("-o --outdir", _STR("."))
_PHRED = ("-p --phred", _INT(33))
_FIGURE = ("-s --show-terminal", _FLAG), ("-W --width", _INT(960)), ("-H --height", _INT(540)), ("-t --types", _STR("png"))

#: Names with aliases, whether there is an INPUT, options, function. Names, flags and defaults are fixed values: those that users' scripts hold.
COMMANDS: list[tuple[str, bool, tuple, Callable[[Job], object]]] = [
    ("topn head", True, (("-n --num", _INT(10)), _OUT), _one(position.topn, "num")),
    ("tail", True, (("-n --num", _INT(10)), _OUT), _one(position.tail, "num")),
    ("concat", False, (("-i --input1", _NEED), ("-I --input2", _NEED), ("-o --out1", _NEED), ("-O --out2", _NEED)), _concat),
    ("subfq sample", True, (("-n --num", _NEED_INT), ("-s --seed", _INT(69)), ("-r --rdc", _FLAG), _OUT), _one(sample.sample, "num", "seed")),
    ("select", False, (*_MATES, *_TWO), _select),
    ("trim", True, (("-l --left", _INT(0)), ("-r --right", _INT(0)), ("-d --discard", _INT(0)), _OUT), _one(rowwise.trim, "left", "right", "discard")),
    ("adapter", True, (("-f --fasta", _NEED), ("-l --left", _FLAG), ("-m --miss", _INT(0)), _OUT), lambda job: job.reads(rowwise.cut_adapters(job.read(job.o.input), fastq.read_adapters(job.spark, job.o.fasta), job.o.left, job.o.miss), job.o.out)),
    ("filter", False, (*_MATES, ("-n --n-limit", _INT(5)), ("-l --length", _INT(30)), ("-y --complexity", _INT(0)), ("-Q --average_qual", _INT(20)), _PHRED, ("-u --failed", _STR()), *_TWO), _filter),
    ("join", False, (*_MATES, ("-l --length", _INT(30)), ("-m --miss", _FLOAT(0.1)), ("-o --output", {"dest": "out"}), ("-n --non-overlap", _STR())), _join),
    ("range", True, (("-s --skip", _INT(0)), ("-t --take", _NEED_INT), _OUT), _one(position.take_range, "skip", "take")),
    ("search", True, (("-p --pattern", _NEED), ("-i --ignore-case", _FLAG), ("-u --invert-match", _FLAG), _OUT), _search),
    ("grep", True, (("-i --id-list", _NEED), ("-f --full-name", _FLAG), _OUT), _grep),
    ("stats stat", True, (_PHRED, ("-s --sumy", _STR("summary.txt")), ("-c --cycle", _STR())), _stats),
    ("kmer", True, (("-k --kmer-size", _INT(21)), ("-H --header", _FLAG), _OUT), _kmer),
    ("shuffle", True, (("-s --seed", _INT(69)), _OUT), lambda job: job.reads(_numbered(sample.shuffled(job.read(job.o.input), job.o.seed)), job.o.out)),
    ("size", True, (_OUT,), _report(lambda r, o: reports.size_text(aggregate.size(r)))),
    ("slide", True, (("-w --window", _INT(10)), ("-s --step", _INT(5)), ("-S --suffidx", _STR("_slide")), _OUT), _slide),
    ("sort", True, (("-n --sort-by-name", _FLAG), ("-s --sort-by-seq", _FLAG), ("-g --sort-by-gc", _FLAG), ("-l --sort-by-length", _FLAG), ("-r --reverse", _FLAG), _OUT), _sort),
    ("plot", False, (("-d --data", _NEED), ("-p --prefix", _STR("base_plot")), ("-y --ylim", _FLOAT(50.0)), *_FIGURE), _plot),
    ("fq2fa", True, (("-r --remove", _FLAG), _OUT), _lines(lambda r, o: rowwise.fasta_lines(rowwise.to_fasta(r, o.remove)))),
    ("fq2sam", False, (("-1 --read1", _NEED), ("-2 --read2", _STR()), ("-s --sample-name", _NEED), ("-r --read-group-name", _STR("A")), ("-l --library-name", _STR()), ("-p --platform", _STR()), _OUT), _fq2sam),
    ("fqscore", True, (("--to33", _FLAG), ("--to64", _FLAG), _OUT), _one(rowwise.rescore, "to33", "to64")),
    ("flatten flat", True, (("-f --field", _INT(3)), ("-s --sep", _STR("\t")), ("-n --gap-n", _FLAG), ("-l --length", _FLAG), ("-g --gc-content", _FLAG), _OUT), _lines(lambda r, o: rowwise.flatten(r, o.field, o.sep, o.gap_n, o.length, o.gc_content))),
    ("barcode demux", False, (*_MATES, ("-b --barcode", _NEED), ("-m --mode", _INT(2)), ("-r --rev_comp", _FLAG), ("-e --error", _INT(0)), *_PACK), _barcode),
    ("remove rm", True, (("-n --name", _NEED), ("-s --save", _STR("rm.fq.gz")), ("-r --remove", _FLAG), _OUT), _remove),
    ("rename rn", True, (("-k --keep", _FLAG), ("-p --prefix", _STR()), ("-l --label", _STR("")), ("-b --before", _FLAG), _OUT), _one(rowwise.rename, "prefix", "label", "before", "keep")),
    ("reverse rev", True, (("-r --reverse", _FLAG), _OUT), _one(rowwise.reverse, "reverse")),
    ("split", True, (("-p --prefix", _STR("demo")), *_PACK), _split),
    ("merge", False, (*_MATES, _OUT), lambda job: job.reads(position.interleave(job.read(job.o.read1), job.read(job.o.read2)), job.o.out)),
    ("mask", True, (_PHRED, ("-l --low-quality", _INT(5)), ("-c --char", _STR("N")), _OUT), _mask),
    ("split2", True, (("-n --num", _INT(200_000)), ("-p --prefix", _STR("sub")), *_PACK), _split2),
    ("gcplot gc", True, (("-p --prefix", _STR("gc_plot")), ("-y --ylim", _FLOAT(15.0)), *_FIGURE, _OUT), _gcplot),
    ("length len", True, (("-r --reverse", _FLAG), _OUT), _report(lambda r, o: reports.length_text(aggregate.lengths(r), o.reverse))),
    ("view", True, (_OUT,), _view),
]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="basewright", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-@", "--threads", type=int, default=4)
    common.add_argument("--compress-level", type=int, choices=range(1, 10), default=6, metavar="1-9")
    common.add_argument("--output-type", choices="ugbx", default="u")
    common.add_argument("--log")
    common.add_argument("-v", "--verbosity", action="count", default=0)
    common.add_argument("-q", "--quiet", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    for names, has_input, options, function in COMMANDS:
        name, *aliases = names.split()
        one = commands.add_parser(name, aliases=aliases, parents=[common])
        if has_input:
            one.add_argument("input", **_IN)
        for flags, settings in options:
            one.add_argument(*flags.split(), **settings)
        one.set_defaults(function=function)
    return out


def run(spark: SparkSession, *args: str) -> object:
    """One command by its arguments, in a session there is."""
    options = parser().parse_args([str(x) for x in args])
    options.stdin = None
    try:
        return options.function(Job(spark, options))
    finally:
        if options.stdin:
            os.unlink(options.stdin)


def main(args: list[str] | None = None) -> int:
    options = parser().parse_args(args)
    handler = logging.FileHandler(options.log, "w") if options.log else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
    LOG.handlers, LOG.propagate = [handler], False
    LOG.setLevel(logging.CRITICAL if options.quiet else LEVELS[min(options.verbosity, 5) or 4])
    spark = SparkSession.builder.master(f"local[{options.threads}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    began = time.time()
    try:
        run(spark, *(sys.argv[1:] if args is None else args))
    except (ValueError, OSError, PySparkException) as wrong:
        LOG.error("%s", str(wrong).splitlines()[0])
        return 1
    LOG.info("time elapsed: %.3f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())

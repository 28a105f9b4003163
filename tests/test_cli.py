import gzip
import io
import random
import sys
from pathlib import Path

import pytest

from basewright import cli
from basewright.sources import fastq

RND = random.Random(4)


def some(n, length=40):
    return [(f"r{i} x{i % 3}", "".join(RND.choice("ACGT") for _ in range(length)), "".join(RND.choice("#5?I") for _ in range(length))) for i in range(n)]


def text(records):
    return "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in records)


def back(path):
    data = path.read_bytes()
    lines = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode().splitlines()
    return [(lines[i][1:], lines[i + 1], lines[i + 3]) for i in range(0, len(lines), 4)]


def run(spark, *args):
    """The command with files of this folder by their whole path: the JVM doesn't follow a change of folder."""
    return cli.run(spark, args[0], *(str(Path.cwd() / x) if isinstance(x, str) and (Path.cwd() / x).is_file() else x for x in args[1:]))


@pytest.fixture
def files(tmp_path):
    one = some(30)
    comp = str.maketrans("ACGT", "TGCA")
    two = [(a, b[::-1].translate(comp), c) for a, b, c in one]
    (tmp_path / "1.fq").write_text(text(one))
    (tmp_path / "2.fq").write_text(text(two))
    (tmp_path / "ids").write_text("r1\nr5\nr5 x2\n")
    (tmp_path / "a.fa").write_text(f">x\n{one[3][1][-8:]}\n")
    (tmp_path / "codes").write_text("".join(f"{two[i][1][-8:][::-1]}\ts{i}\n" for i in (2, 4)))
    (tmp_path / "list").write_text(f"{tmp_path}/1.fq\n{tmp_path}/2.fq\n")
    return tmp_path, one, two


def test_commands_on_one_file(spark, files, monkeypatch):
    d, one, _ = files
    monkeypatch.chdir(d)

    def ran(*args):
        run(spark, args[0], "1.fq", *args[1:], "-o", "out.fq")
        return back(d / "out.fq")

    assert ran("topn", "-n", 3) == ran("head", "-n", 3) == one[:3]
    assert ran("tail", "-n", 4) == one[-4:]
    assert ran("range", "-s", 5, "-t", 2) == one[5:7]
    assert ran("trim", "-l", 2, "-r", 3) == [(a, b[2:-3], c[2:-3]) for a, b, c in one]
    assert ran("search", "-p", "ACG") == [x for x in one if "ACG" in x[1]]
    assert ran("search", "-p", "acg", "-i", "-u") == [x for x in one if "ACG" not in x[1]]
    assert ran("grep", "-i", "ids") == [one[1], one[5]]
    assert ran("remove", "-n", "ids", "-s", "gone.fq.gz") == one[:5] + one[6:] and back(d / "gone.fq.gz") == [one[5]]
    assert sorted(ran("shuffle")) == sorted(one) != ran("shuffle") and ran("sort", "-s") == sorted(one, key=lambda x: x[1])
    assert ran("sort", "-n", "-r") == sorted(one, key=lambda x: x[0], reverse=True)
    assert [x for x in one if x in ran("subfq", "-n", 7)] == ran("sample", "-n", 7) and len(ran("subfq", "-n", 7)) == 7
    assert ran("reverse", "-r") == [(a, b[::-1], c[::-1]) for a, b, c in one]
    assert ran("rename", "-p", "n", "-l", "_")[:2] == [("n_1", *one[0][1:]), ("n_2", *one[1][1:])]
    assert ran("mask", "-l", 2, "-c", "x")[0][1] == "".join("x" if q == "#" else b for b, q in zip(*one[0][1:], strict=True))
    assert ran("fqscore", "--to64")[0][2] == "".join(chr(ord(q) + 31) for q in one[0][2])
    assert ran("adapter", "-f", "a.fa")[3] == (one[3][0], one[3][1][:-8], one[3][2][:-8])
    slid = ran("slide", "-w", 30, "-s", 5)
    assert [x[0] for x in slid[:3]] == [f"r0 x0_slide:{a}-{a + 29}" for a in (1, 6, 11)] and len(slid) == 90
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n" * 20))
    assert ran("view") == one
    run(spark, "fq2fa", "1.fq", "-r", "-o", "out.fa")
    assert (d / "out.fa").read_text().splitlines()[:2] == [">r0", one[0][1]]
    run(spark, "flatten", "1.fq", "-f", 2, "-s", ",", "-l", "-o", "flat.txt")
    assert (d / "flat.txt").read_text().splitlines()[0] == f"{one[0][1]},40,"
    run(spark, "split", "1.fq", "-z", "-p", "s")
    assert back(d / "s_r1.fq.gz") == one[::2] and back(d / "s_r2.fq.gz") == one[1::2]
    assert run(spark, "split2", "1.fq", "-n", 12, "-p", "c") == {0: 12, 1: 12, 2: 6} and back(d / "c2.fq") == one[24:]
    (d / "none").write_text("")
    for wrong in (("split2", "1.fq", "-z", "-x"), ("grep", "1.fq", "-i", "none"), ("sort", "1.fq"), ("sort", "1.fq", "-n", "-g"), ("split", "1.fq", "-o", "no_such_folder")):
        with pytest.raises(ValueError):
            run(spark, *wrong)
    run(spark, "split2", "1.fq", "-n", 12, "-o", f"file://{d}/parts")
    assert sorted(x.name for x in (d / "parts").glob("chunk=*")) == ["chunk=0", "chunk=1", "chunk=2"]
    assert back(next((d / "parts" / "chunk=2").glob("*.txt"))) == one[24:]
    run(spark, "topn", "1.fq", "-n", 1, "-o", "more.fq.gz", "--compress-level", 9)
    assert back(d / "more.fq.gz") == one[:1]


def test_log_levels_and_elapsed_time(files):
    d, *_ = files
    for flags, expected in ((["-v"], 0), ([], 1), (["-q"], 0)):
        assert cli.main(["size", f"{d}/1.fq", "-o", f"{d}/s.txt", "--log", f"{d}/log", *flags]) == 0
        assert (d / "log").read_text().count("time elapsed") == expected
    assert cli.main(["tail", f"{d}/1.fq", "-n", "2", "-o", f"{d}/no/such/folder.fq", "--log", f"{d}/log"]) == 1
    assert "ERROR" in (d / "log").read_text()


def test_commands_on_pairs(spark, files, monkeypatch):
    d, one, two = files
    monkeypatch.chdir(d)
    mates = ("-1", "1.fq", "-2", "2.fq")
    run(spark, "merge", *mates, "-o", "m.fq")
    assert back(d / "m.fq") == [x for p in zip(one, two, strict=True) for x in p]
    run(spark, "concat", "-i", "list", "-I", "list", "-o", "c1.fq", "-O", "c2.fq.gz")
    assert back(d / "c1.fq") == back(d / "c2.fq.gz") == one + two
    (d / "3.fq").write_text(text(two[10:]))
    run(spark, "select", "-1", "1.fq", "-2", "3.fq", "-f", "f.fq", "-r", "r.fq")
    assert back(d / "f.fq") == one[10:] and back(d / "r.fq") == two[10:]
    run(spark, "filter", *mates, "-Q", 9, "-f", "f.fq", "-r", "r.fq", "-u", "bad.fq")
    good, bad = back(d / "f.fq"), back(d / "bad.fq")
    assert [x[0] for x in good] == [x[0] for x in back(d / "r.fq")] and sorted(good + bad[::2]) == sorted(one) and good and bad
    assert run(spark, "join", *mates, "-l", 40, "-o", "j.fq", "-n", "no.fq") == 30 and [x[1] for x in back(d / "j.fq")] == [x[1] for x in one]
    run(spark, "barcode", *mates, "-b", "codes")
    assert back(d / "s2_1.fq") == [one[2]] and back(d / "s4_2.fq")[0][1] == two[4][1][:-8] and back(d / "s4_barcode.fq")[0][1] == two[4][1][-8:]
    run(spark, "fq2sam", *mates, "-s", "me", "-o", "x.sam")
    lines = (d / "x.sam").read_text().splitlines()
    assert lines[1].startswith("@RG\tID:A\tSM:me") and [x.split("\t")[1] for x in lines[2:6]] == ["77", "141", "77", "141"]


def test_reports_and_figures(spark, files, monkeypatch):
    d, one, _ = files
    monkeypatch.chdir(d)
    run(spark, "stats", "1.fq", "-c", "cycles.txt")
    assert "total read count:\t30" in (d / "summary.txt").read_text()
    run(spark, "plot", "-d", "cycles.txt", "-t", "svg", "-s")
    run(spark, "plot", "-d", "cycles.txt", "-p", "p")
    assert (d / "base_plot.svg").read_text().count("<polyline") == 5 and (d / "p.png").read_bytes()[1:4] == b"PNG"
    run(spark, "gc", "1.fq", "-o", "gc.txt", "-t", "svg", "-y", 100)
    assert len((d / "gc.txt").read_text().splitlines()) == 102
    run(spark, "kmer", "1.fq", "-k", 3, "-H", "-o", "k.txt")
    rows = [x.split("\t") for x in (d / "k.txt").read_text().splitlines()]
    assert rows[0] == ["kmer", "count"] and sum(int(n) for _, n in rows[1:]) == 30 * 38
    run(spark, "length", "1.fq", "-o", "l.txt")
    assert (d / "l.txt").read_text().splitlines()[1] == "40\t30"
    with pytest.raises(ValueError):
        run(spark, "plot", "-d", "cycles.txt", "-t", "gif")


def test_appending_and_golden_summary(spark, files, monkeypatch):
    d, one, _ = files
    monkeypatch.chdir(d)
    for _ in range(2):
        run(spark, "split", "1.fq", "-z", "-p", "twice", "--append")
    assert back(d / "twice_r1.fq.gz") == one[::2] * 2
    assert [x.seq for x in fastq.read_fastq(spark, f"{d}/twice_r1.fq.gz").orderBy("read_idx").collect()] == [x[1] for x in one[::2] * 2]
    (d / "two.fq").write_text("@a\nACGTN\n+\nII5+#\n@b\nGG\n+\nI!\n")
    run(spark, "stats", "two.fq", "-s", "two.txt", "-c", "two.cyc")
    assert (d / "two.txt").read_text() == (
        "read average length:\t4\nread min length:\t2\nread max length:\t5\ntotal gc content(%):\t57.14\ntotal read count:\t2\ntotal base count:\t7\n\n"
        "base A count:\t1\t(14.29%)\nbase T count:\t1\t(14.29%)\nbase G count:\t3\t(42.86%)\nbase C count:\t1\t(14.29%)\nbase N count:\t1\t(14.29%)\n\n"
        + "".join(f"Number of base calls with quality value of {q} or higher (Q{q}+) (%)\t{n}\t({p}%)\n" for q, n, p in ((5, 5, "71.43"), (10, 5, "71.43"), (15, 4, "57.14"), (20, 4, "57.14"), (30, 3, "42.86")))
    )
    first = (d / "two.cyc").read_text().splitlines()
    assert first[0].split("\t")[:7] == ["cycle", "A", "T", "G", "C", "N", "0"] and first[1].startswith("cyc1\t1:(50.00%)\t0:(0.00%)\t1:(50.00%)\t0:(0.00%)\t0:(0.00%)\t0")


def test_standard_input_and_output(spark, files, monkeypatch, capfdbinary):
    d, one, _ = files
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(gzip.compress((d / "1.fq").read_bytes()))))
    capfdbinary.readouterr()
    run(spark, "topn", "-n", 2, "--output-type", "g")
    assert gzip.decompress(capfdbinary.readouterr().out).decode() == text(one[:2])


def test_all_names_are_there():
    names = [x.split() for x, *_ in cli.COMMANDS]
    assert len({x for n in names for x in n}) == 34 + 10 and len(names) == 34
    assert cli.main(["topn", "/no/such/file"]) == 1

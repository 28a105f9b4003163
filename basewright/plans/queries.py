"""A query for each operator on the derived reads, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.operators import aggregate, demux, paired, position, rowwise, sample, select
from basewright.plans import ORACLES, QUERIES
from basewright.plans.fixtures import ADAPTERS, BARCODES, made, mates, oracle

Step = Callable[[DataFrame], DataFrame]
ROW = "read_idx, id, seq, qual"


def over(table: str, name: str, step: Step, sql: str | None) -> None:
    """Register a query over reads, pairs or tagged pairs."""
    QUERIES[name] = lambda spark, sf_dir: step(made(spark, sf_dir, table))
    if sql:
        ORACLES[name] = oracle(sql)


def reads(name: str, step: Step, sql: str) -> None:
    over("reads", name, step, sql)


def _ids(reads: DataFrame, short: bool) -> DataFrame:
    listed = reads.where("read_idx % 17 = 0")
    return listed.select(F.substring_index("id", " ", 1) if short else F.col("id"))


# by position
reads("topn", lambda r: position.topn(r, 10), f"SELECT {ROW} FROM reads WHERE read_idx < 10")
reads("tail", lambda r: position.tail(r, 10), f"SELECT {ROW} FROM reads ORDER BY read_idx DESC LIMIT 10")
reads("range", lambda r: position.take_range(r, 100, 50), f"SELECT {ROW} FROM reads WHERE read_idx >= 100 AND read_idx < 150")
reads("view_page", lambda r: position.page(r, 3, 42), f"SELECT {ROW} FROM reads WHERE read_idx >= 30 AND read_idx < 40")
reads("split_r1", lambda r: position.split_interleaved(r)[0], "SELECT read_idx // 2 AS read_idx, id, seq, qual FROM reads WHERE read_idx % 2 = 0")
reads("split_r2", lambda r: position.split_interleaved(r)[1], "SELECT read_idx // 2 AS read_idx, id, seq, qual FROM reads WHERE read_idx % 2 = 1")
reads("split2", lambda r: position.split_chunks(r, 400).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("read_idx").alias("first_read")), "SELECT read_idx // 400 AS chunk, count(*) AS n, min(read_idx) AS first_read FROM reads GROUP BY 1")
over("pairs", "concat", lambda p: position.concat(list(mates(p))), "SELECT read_idx, id1 AS id, seq1 AS seq, qual1 AS qual FROM pairs UNION ALL SELECT read_idx + (SELECT max(read_idx) + 1 FROM pairs) AS read_idx, id2 AS id, seq2 AS seq, qual2 AS qual FROM pairs")
reads("concat_whole", lambda r: position.concat([r, r]), f"SELECT {ROW} FROM reads UNION ALL SELECT read_idx + (SELECT max(read_idx) + 1 FROM reads) AS read_idx, id, seq, qual FROM reads")
over("pairs", "merge", lambda p: position.interleave(*mates(p)), "SELECT 2 * read_idx AS read_idx, id1 AS id, seq1 AS seq, qual1 AS qual FROM pairs UNION ALL SELECT 2 * read_idx + 1, id2, seq2, qual2 FROM pairs")

for _name, _key, _sql in (("name", "name", "id"), ("seq", "seq", "seq"), ("length", "length", "length(seq)"), ("gc", "gc", "(length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq)::DOUBLE")):
    for _down in (False, True):
        reads(
            f"sort_{_name}" + "_desc" * _down,
            lambda r, key=_key, down=_down: position.renumbered(position.sort_reads(r, key, down)).select("read_idx", "id", "rank"),
            f"SELECT read_idx, id, row_number() OVER (ORDER BY {_sql} {'DESC' if _down else 'ASC'}, read_idx) - 1 AS rank FROM reads",
        )
reads("shuffle", lambda r: position.renumbered(sample.shuffled(r)).select("read_idx", "id", "rank"), "SELECT read_idx, id, row_number() OVER (ORDER BY md5('69:' || CAST(read_idx AS VARCHAR)), read_idx) - 1 AS rank FROM reads")
reads("subfq", lambda r: sample.sample(r, 500), f"SELECT {ROW} FROM reads ORDER BY md5('69:' || CAST(read_idx AS VARCHAR)), read_idx LIMIT 500")

# by content
reads("search", lambda r: select.search(r, "ACG[TN]A"), f"SELECT {ROW} FROM reads WHERE regexp_matches(seq, 'ACG[TN]A')")
reads("search_icase", lambda r: select.search(r, "acgta", ignore_case=True), f"SELECT {ROW} FROM reads WHERE regexp_matches(seq, '(?i)acgta')")
reads("search_invert", lambda r: select.search(r, "GG", invert=True), f"SELECT {ROW} FROM reads WHERE NOT regexp_matches(seq, 'GG')")
reads("grep_id", lambda r: select.grep(r, _ids(r, True)), f"SELECT {ROW} FROM reads WHERE split_part(id, ' ', 1) IN (SELECT split_part(id, ' ', 1) FROM reads WHERE read_idx % 17 = 0)")
reads("grep_full", lambda r: select.grep(r, _ids(r, True), full=True), f"SELECT {ROW} FROM reads WHERE id IN (SELECT split_part(id, ' ', 1) FROM reads WHERE read_idx % 17 = 0)")
reads("remove_kept", lambda r: select.remove(r, _ids(r, False))[0], f"SELECT {ROW} FROM reads WHERE id NOT IN (SELECT id FROM reads WHERE read_idx % 17 = 0)")
reads("remove_removed", lambda r: select.remove(r, _ids(r, False))[1], f"SELECT {ROW} FROM reads WHERE id IN (SELECT id FROM reads WHERE read_idx % 17 = 0)")
over("pairs", "select_r1", lambda p: select.select_pairs(*mates(p))[0], "SELECT read_idx, id1 AS id, seq1 AS seq, qual1 AS qual FROM pairs WHERE id1 IN (SELECT id2 FROM pairs)")
over("pairs", "select_r2", lambda p: select.select_pairs(*mates(p))[1], "SELECT read_idx, id2 AS id, seq2 AS seq, qual2 AS qual FROM pairs WHERE id2 IN (SELECT id1 FROM pairs)")

# row by row
reads("trim", lambda r: rowwise.trim(r, 3, 5, 40), "SELECT read_idx, id, substr(seq, 4, length(seq) - 8) AS seq, substr(qual, 4, length(qual) - 8) AS qual FROM reads WHERE length(seq) - 8 >= 40")
_END = "hamming(right(seq, 10), 'AGATCGGAAG') <= 1"
reads("adapter_right", lambda r: rowwise.cut_adapters(r, ADAPTERS, mismatch=1), f"SELECT read_idx, id, CASE WHEN {_END} THEN left(seq, length(seq) - 10) ELSE seq END AS seq, CASE WHEN {_END} THEN left(qual, length(qual) - 10) ELSE qual END AS qual FROM reads")
_START = "hamming(left(seq, 3), 'ACG') <= 1"
_START2 = "hamming(left(seq, 5), 'GGTTA') <= 1"
reads("adapter_left", lambda r: rowwise.cut_adapters(r, ["GGTTA", "ACG"], left=True, mismatch=1), f"SELECT read_idx, id, CASE WHEN {_START2} THEN substr(seq, 6) WHEN {_START} THEN substr(seq, 4) ELSE seq END AS seq, CASE WHEN {_START2} THEN substr(qual, 6) WHEN {_START} THEN substr(qual, 4) ELSE qual END AS qual FROM reads")
reads("mask", lambda r: rowwise.mask(r, 20, "N"), "SELECT read_idx, id, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN ascii(substr(qual, i::INT, 1)) - 33 <= 20 THEN 'N' ELSE substr(seq, i::INT, 1) END), '') AS seq, qual FROM reads")
for _to, _by in (("to64", 31), ("to33", -31)):
    reads(f"fqscore_{_to}", lambda r, to=_to: rowwise.rescore(rowwise.rescore(r, to64=True) if to == "to33" else r, **{to: True}), f"SELECT read_idx, id, seq, array_to_string(list_transform(string_split(qual, ''), lambda c: chr(ascii(c) + 31 {'- 31' if _by < 0 else ''})), '') AS qual FROM reads")
reads("reverse_complement", rowwise.reverse, "SELECT read_idx, id, regexp_replace(translate(reverse(seq), 'ACGT', 'TGCA'), '[^ACGTN]', 'N', 'g') AS seq, reverse(qual) AS qual FROM reads")
reads("reverse_only", lambda r: rowwise.reverse(r, only=True), "SELECT read_idx, id, reverse(seq) AS seq, reverse(qual) AS qual FROM reads")
_FIRST, _REST = "split_part(id, ' ', 1)", "substr(id, length(split_part(id, ' ', 1)) + 1)"
for _name, _args, _sql in (
    ("prefix_before", {"prefix": "P", "label": "L", "before": True}, "'LP' || (read_idx + 1)"),
    ("prefix_before_keep", {"prefix": "P", "label": "L", "before": True, "keep": True}, f"'LP' || (read_idx + 1) || {_REST}"),
    ("prefix", {"prefix": "P", "label": "L"}, "'PL' || (read_idx + 1)"),
    ("prefix_keep", {"prefix": "P", "label": "L", "keep": True}, f"'PL' || (read_idx + 1) || {_REST}"),
    ("before_keep", {"label": "L", "before": True, "keep": True}, "'L' || id"),
    ("before", {"label": "L", "before": True}, f"'L' || {_FIRST}"),
    ("keep", {"label": "L", "keep": True}, f"{_FIRST} || 'L' || {_REST}"),
    ("label", {"label": "L"}, f"{_FIRST} || 'L'"),
):
    reads(f"rename_{_name}", lambda r, args=_args: rowwise.rename(r, **args).select("read_idx", "id"), f"SELECT read_idx, {_sql} AS id FROM reads")
reads("fq2fa", rowwise.to_fasta, "SELECT read_idx, id, seq FROM reads")
reads("fq2fa_nodesc", lambda r: rowwise.fasta_lines(rowwise.to_fasta(r, True)), f"SELECT read_idx, '>' || {_FIRST} || chr(10) || seq AS value FROM reads")
_TAB = "chr(9)"
_SAM = f"concat_ws({_TAB}, %s, '%s', '*', '0', '0', '*', '*', '0', '0', %s, %s, 'RG:Z:A')"
reads("fq2sam_se", rowwise.to_sam, f"SELECT read_idx, 1 AS mate, {_SAM % ('id', 4, 'seq', 'qual')} AS value FROM reads")
over("pairs", "fq2sam_pe", lambda p: rowwise.to_sam(*mates(p)), f"SELECT read_idx, 1 AS mate, {_SAM % ('id1', 77, 'seq1', 'qual1')} AS value FROM pairs UNION ALL SELECT read_idx, 2, {_SAM % ('id2', 141, 'seq2', 'qual2')} FROM pairs")
reads("flatten_f3", rowwise.flatten, f"SELECT read_idx, id || {_TAB} || seq || {_TAB} AS value FROM reads")
reads("flatten_f11_nl", lambda r: rowwise.flatten(r, 11, ",", gap=True, length=True), "SELECT read_idx, id || ',' || seq || ',' || qual || ',' || (length(seq) - length(replace(seq, 'N', ''))) || ',' || length(seq) || ',' AS value FROM reads")
reads("slide", rowwise.slide, "SELECT read_idx, part, id || '_slide:' || (part * 5 + 1) || '-' || least(part * 5 + 10, length(seq)) AS id, substr(seq, part * 5 + 1, 10) AS seq, substr(qual, part * 5 + 1, 10) AS qual FROM (SELECT *, unnest(range(0, CASE WHEN length(seq) > 10 THEN CAST(ceil((length(seq) - 10) / 5.0) AS INT) ELSE 0 END + 1))::INT AS part FROM reads) WHERE part * 5 < length(seq)")

# statistics
_N = "CAST(sum(length({0}) - length(translate({0}, '{1}', ''))) AS BIGINT)"
_COUNTS = ", ".join(f"{_N.format('seq', b)} AS {b.lower()}" for b in "ATGCN")
reads("size", aggregate.size, f"SELECT reads, a + t + g + c + n AS bases, a, t, g, c, n FROM (SELECT count(*) AS reads, {_COUNTS} FROM reads)")
_HIGH = {q: "".join(chr(x) for x in range(q + 33, 127)).replace("'", "''") for q in aggregate.QUALITIES}
_QS = ", ".join(f"{_N.format('qual', _HIGH[q])} AS q{q}" for q in _HIGH)
_PCT = ", ".join(f"100.0::DOUBLE * {x} / bases AS {x}_pct" for x in [*"atgcn", *(f"q{q}" for q in _HIGH)])
reads("stats_summary", aggregate.summary, f"SELECT *, bases::DOUBLE / reads AS mean_length, 100.0::DOUBLE * (g + c) / bases AS gc_pct, {_PCT} FROM (SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(min(length(seq)) AS BIGINT) AS min_length, CAST(max(length(seq)) AS BIGINT) AS max_length, {_COUNTS}, {_QS} FROM reads)")
_PLACES = "SELECT unnest(range(1, length(seq) + 1))::INT AS cycle, seq, qual FROM reads"
_BY = ", ".join(f"count(*) FILTER (substr(seq, cycle, 1) = '{b}') AS {b.lower()}" for b in "ATGCN")
_POINTS = ", ".join(f"100.0::DOUBLE * {b} / (a + t + g + c + n) AS {b}_pct" for b in "atgcn")
_CYCLES = f"SELECT cycle, {_BY} FROM ({_PLACES}) GROUP BY 1"
reads("stats_cycle_bases", aggregate.cycle_bases, f"SELECT *, {_POINTS} FROM ({_CYCLES})")
reads("plot_points", lambda r: aggregate.cycle_bases(r).select("cycle", *[f"{b}_pct" for b in "atgcn"]), f"SELECT cycle, {_POINTS} FROM ({_CYCLES})")
reads("stats_cycle_quals", aggregate.cycle_qualities, f"SELECT cycle, ascii(substr(qual, cycle, 1)) - 33 AS q, count(*) AS n FROM ({_PLACES}) GROUP BY 1, 2")
reads("length_hist", aggregate.lengths, "SELECT CAST(length(seq) AS INT) AS length, count(*) AS n FROM reads GROUP BY 1")
reads("gc_hist", aggregate.gc_histogram, "SELECT CAST(g AS INT) AS gc, coalesce(n, 0) AS reads, coalesce(round(n * 10000.0::DOUBLE / (SELECT count(*) FROM reads)) / 100, 0) AS ratio FROM range(101) t(g) LEFT JOIN (SELECT CAST(round(100 * ((length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq))) AS INT) AS gc, count(*) AS n FROM reads GROUP BY 1) h ON h.gc = g")
reads("kmer", lambda r: aggregate.kmers(r, 7), "SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i::INT, 7) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS i FROM reads)) GROUP BY 1")

# pairs
_MEAN = "round(-10 * log10(list_sum(list_transform(string_split({0}, ''), lambda c: pow(10.0::DOUBLE, (ascii(c) - 33) / -10.0::DOUBLE))) / length({0})))"
_OK = " AND ".join(f"length(seq{m}) >= 30 AND length(seq{m}) - length(replace(seq{m}, 'N', '')) <= 3 AND {_MEAN.format(f'qual{m}')} >= 20" for m in (1, 2))
_PAIR = "read_idx, id1, seq1, qual1, id2, seq2, qual2"
over("pairs", "filter_pass", lambda p: paired.filter_pairs(p, 3).where("passed").drop("passed"), f"SELECT {_PAIR} FROM pairs WHERE {_OK}")
over("pairs", "filter_fail", lambda p: paired.interleaved(paired.filter_pairs(p, 3).where("NOT passed")), f"SELECT 2 * read_idx AS read_idx, id1 AS id, seq1 AS seq, qual1 AS qual FROM pairs WHERE NOT ({_OK}) UNION ALL SELECT 2 * read_idx + 1, id2, seq2, qual2 FROM pairs WHERE NOT ({_OK})")
over("pairs", "filter_complexity", lambda p: paired.filter_pairs(p, 3, complexity=70).groupBy("passed").agg(F.count(F.lit(1)).alias("n")), f"SELECT passed, count(*) AS n FROM (SELECT ({_OK} AND " + " AND ".join(f"100.0 * len(list_filter(range(1, length(seq{m})), lambda i: substr(seq{m}, i::INT, 1) <> substr(seq{m}, i::INT + 1, 1))) / (length(seq{m}) - 1) >= 70" for m in (1, 2)) + ") AS passed FROM pairs) GROUP BY 1")
over("pairs", "filter_summary", lambda p: paired.filter_pairs(p, 3).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")), f"SELECT count(*) FILTER ({_OK}) AS passed, count(*) FILTER (NOT ({_OK})) AS failed FROM pairs")
_JOIN = """, o AS (SELECT *, translate(reverse(seq2), 'ACGT', 'TGCA') AS r, reverse(qual2) AS rq FROM pairs),
k AS (SELECT *, coalesce(list_filter(range(80, 29, -1), lambda x: hamming(right(seq1, x::INT), left(r, x::INT)) / x <= 0.1)[1], 0)::INT AS overlap FROM o),
j AS (SELECT *, CASE WHEN overlap > 0 THEN hamming(right(seq1, overlap), left(r, overlap)) ELSE 0 END AS mismatches FROM k) """
_PICK = "array_to_string(list_transform(range(1, overlap + 1), lambda i: CASE WHEN ascii(substr(qual1, (80 - overlap + i)::INT, 1)) >= ascii(substr(rq, i::INT, 1)) THEN substr({0}, (80 - overlap + i)::INT, 1) ELSE substr({1}, i::INT, 1) END), '')"
over("pairs", "join_overlap", lambda p: paired.join_overlap(p).where("overlap > 0").select("read_idx", F.col("id1").alias("id"), "seq", "qual", "overlap"), _JOIN + f"SELECT read_idx, id1 AS id, left(seq1, 80 - overlap) || {_PICK.format('seq1', 'r')} || substr(r, overlap + 1) AS seq, left(qual1, 80 - overlap) || {_PICK.format('qual1', 'rq')} || substr(rq, overlap + 1) AS qual, overlap FROM j WHERE overlap > 0")
over("pairs", "join_nonoverlap", lambda p: paired.interleaved(paired.join_overlap(p).where("overlap = 0").drop("seq", "qual")), _JOIN + "SELECT 2 * read_idx AS read_idx, id1 AS id, seq1 AS seq, qual1 AS qual FROM j WHERE overlap = 0 UNION ALL SELECT 2 * read_idx + 1, id2, seq2, qual2 FROM j WHERE overlap = 0")
over("pairs", "join_summary", lambda p: paired.join_summary(paired.join_overlap(p)), _JOIN + "SELECT count(*) FILTER (overlap > 0) AS joined, count(*) AS total, CAST(sum(overlap) AS BIGINT) AS overlap_bases, CAST(sum(mismatches) AS BIGINT) AS mismatches, 100.0::DOUBLE * count(*) FILTER (overlap > 0) / count(*) AS joined_pct FROM j")


def _barcode(name: str, mode: int, complement: bool, mismatch: int) -> None:
    cases = {}
    for key, found in demux.keys(BARCODES, complement):
        part = f"left(seq2, {len(key)})" if mode == 1 else f"right(seq2, {len(key)})"
        cases[key] = f"WHEN length(seq2) >= {len(key)} AND hamming({part}, '{key}') <= {mismatch} THEN", found
    which = "CASE " + " ".join(f"{c} '{found}'" for c, found in cases.values()) + " END"
    size = "CASE " + " ".join(f"{c} {len(k)}" for k, (c, _) in cases.items()) + " END"
    rest = "substr({0}, n + 1)" if mode == 1 else "left({0}, length({0}) - n)"
    part = "left({0}, n)" if mode == 1 else "right({0}, n)"
    found = f", m AS (SELECT *, {which} AS sample, {size} AS n FROM tagged) "
    over("tagged", name, lambda p: demux.demultiplex(p, BARCODES, mode, mismatch, complement), found + f"SELECT read_idx, id1, id2, seq1, qual1, sample, {rest.format('seq2')} AS seq2, {rest.format('qual2')} AS qual2, {part.format('seq2')} AS barcode_seq, {part.format('qual2')} AS barcode_qual FROM m WHERE sample IS NOT NULL")
    if name == "barcode_right":
        over("tagged", "barcode_summary", lambda p: demux.split_rate(demux.demultiplex(p, BARCODES, mode, mismatch, complement)), found + "SELECT sample, count(*) AS n FROM m WHERE sample IS NOT NULL GROUP BY 1")


_barcode("barcode_right", 2, False, 1)
_barcode("barcode_left", 1, False, 3)
_barcode("barcode_revcomp", 2, True, 3)


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basewright.sources import fastq

    return fastq.roundtrip(made(spark, sf_dir, "reads"))


QUERIES["fastq_roundtrip"] = _roundtrip
ORACLES["fastq_roundtrip"] = oracle(f"SELECT {ROW} FROM reads")

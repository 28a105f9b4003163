"""Rows that any table may hold: nulls, repeats, empty and very long texts, clashing columns, no rows at all."""

import random

import pytest

import corpus_pipeline
from basewright.llm import bpe, cotraining, decontaminate, jaccard, linechunks, multiset, registry, sharding, suffixes, toxicity, warc

duckdb = pytest.importorskip("duckdb")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, hash string, label int, views string, bucket string, unit int, _c int"


def nasty(seed=1):
    rnd = random.Random(seed)
    passage = "\n".join(" ".join(f"p{i}w{k}" for k in range(12)) for i in range(4))
    texts = [None, "", " ", "\n\n", "...", "one", "é" * 70, "日本語 " * 30, "a" * 300, passage, passage + "\nand more of it", "x\n" + passage, "\n".join(["same line here"] * 9)]
    texts += [" ".join(rnd.choice("red green blue grey\n".split(" ")) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 80))) for _ in range(25)]
    ids = [None, None, 5, 5, *range(10, 10 + len(texts))]
    rows = [(d, t, rnd.choice(["en", None]), rnd.choice(["web", None]), rnd.choice([None, 7]), "n", None, 1, "v", "b", 3, None) for d, t in zip(ids, texts, strict=False)]
    return rows + rows[:4] + [(rows[12][0], rows[12][1], "de", None, 1, None, "h", None, None, None, None, 9), (None, passage, *rows[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA)


ITEMS = [(1, " ".join(f"p1w{k}" for k in range(12))), (None, "one"), (2, None), (2, "")]
LABELS = [(d, d % 2, int(d % 5 == 0)) for d in range(10, 40)] + [(None, 1, 1), (12, None, None), (5, 1, 0), (5, 0, 1), (999, 1, 1)]
QUERIES = {
    "op1": lambda d, i, n: jaccard.links(d),
    "op2": lambda d, i, n: multiset.digests(d),
    "op3": lambda d, i, n: linechunks.digests(d),
    "op4": lambda d, i, n: suffixes.digests(d),
    "op5": lambda d, i, n: toxicity.severities(d, n),
    "op6": lambda d, i, n: decontaminate.digests(d, i),
    "op7": lambda d, i, n: cotraining.qualities(d, n),
    "op8": lambda d, i, n: bpe.digests(d),
    "op9": lambda d, i, n: sharding.digests(d),
    "op10": lambda d, i, n: warc.digests(d.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "source AS record_key")),
}


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_has_its_result(docs, sides, name):
    got = QUERIES[name](docs, *sides).collect()
    key = "page_id" if name == "op10" else "doc_id"
    assert sorted((x[key] for x in got), key=str) == sorted((r[0] for r in nasty()), key=str)
    assert QUERIES[name](docs.limit(0), *sides).count() == 0


@pytest.mark.parametrize("name", ["op5", "op6", "op7"])
def test_empty_tables_beside_the_documents(docs, sides, name):
    assert QUERIES[name](docs, sides[0].limit(0), sides[1].limit(0)).count() == docs.count()


def test_stages_on_nasty_rows(spark, docs, sides, tmp_path):
    sides[0].write.parquet(f"{tmp_path}/benchmark.parquet")
    sides[1].write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert len(rows) <= now.count()
            if name != "line_dedup":
                assert set(map(tuple, rows)) <= set(map(tuple, now.collect())), name
            now = spark.createDataFrame(rows, docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()


def test_very_long_texts(spark, sides):
    rnd = random.Random(2)
    long = "\n".join(" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(1, 30))) for _ in range(4_000))
    rows = [(1, long), (2, long), (3, "short"), (4, "y" * 300_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    for name, query in QUERIES.items():
        got = {x[0]: x for x in query(table, *sides).collect()}
        assert sorted(got) == [1, 2, 3, 4], name
    assert {x.doc_id: x.n_removed for x in suffixes.digests(table).collect()} == {1: 0, 2: len(long.encode()), 3: 0, 4: 0}
    assert {x.doc_id: x.n_links for x in jaccard.links(table).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_clashing_columns_are_carried(spark):
    rows = [(1, "a\nb\nc", 9, 5), (1, "a\nb\nc", 5, 6), (None, "d\ne", 7, None), (8, "q\nx\ny\nz", 1, 2), (9, "x\ny\nz\nr", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, n_removed long")
    want = [*rows[:4], (9, "r", 3, 4)]
    assert sorted(map(tuple, linechunks.cleaned(df).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_queries_agree_with_their_sql(spark, tmp_path, seed):
    rows = [(d, t) for d, t, *_ in nasty(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html").where("doc_id IS NOT NULL").dropDuplicates(["page_id"])
    con = duckdb.connect()
    for name, table in (("documents", docs), ("benchmark", items), ("pages", pages)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in registry.ORACLES.items():
        if name.startswith("op6"):  # its SQL joins by doc_id, which has to tell documents apart
            continue
        got = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(found.fetchall(), key=str), name

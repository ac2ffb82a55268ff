"""Each query with SQL against it: on the smallest tables, and on small ones with nulls, repeats, ties and clashing names."""

import duckdb
import pytest

from vocabra.llm import leaks, lines, near, repeats, urls

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(300))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "a b c d e f g h i j k"), (5, "A b c d e f g h i j K"), (6, "x y z " * 40), (7, LONG), (8, LONG + " tail"), (9, LONG + " tail"),
    (9, LONG + " tail"), (10, "short item words here\n" * 3 + "  Same Line \nsame line"), (11, "é É\nÉ é\n\n" + LONG[:200]), (12, "p q r s t u v w x y z p q r s t u v w x y z"), (None, "no id here but words are\nsame line"),
    (None, "no id here but words are\nsame line"), (13, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 and more # $ <b>"), (3, "another text of this id"), *((20 + i, f"Same line\nown {i} " + "q " * i) for i in range(12)),
]
ITEMS = [(0, "W5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (1, "short, item"), (2, None), (3, ""), (10, "w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (4, "item"), (4, "item")]
PAGES = [(0, None), (1, "nothing"), (2, "HTTP://Example.ORG/es/x?y"), (3, "http://a.example.org/en/1#t"), (4, "http://x.com/de/"), (5, "http://x.com/fr"), (6, "http://x.com/x.org/"), (7, "://"), (8, "http://ads.x.net/a"),
         (9, "http://é.net/login"), (10, "http://org"), (11, "http://notexample.org/es/"), (12, "http://a.b/" + "é" * 5000 + ".exe"), (12, "http://x.com/fr/ü")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    extra = "hash string, id long, words int, kept string"
    spark.createDataFrame([(i, t, "h", 1, 2, "k") for i, t in TEXTS], f"doc_id long, text string, {extra}").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, t, "h") for i, t in ITEMS], "item_id long, text string, state string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, u, "v") for i, u in PAGES], "page_id long, url string, verdict string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": "doc_id long, text string", "benchmark": "item_id long, text string", "pages": "page_id long, url string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


def equal(spark, module, folder, glob):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{glob}'")
    df = module.query(spark, folder)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({module.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("module", [repeats, leaks, lines, urls, near])
def test_smallest_tables(spark, module):
    equal(spark, module, SF, "")


@pytest.mark.parametrize("module", [repeats, leaks, lines, urls])
def test_odd_rows(spark, small, module):
    equal(spark, module, small, "/*.parquet")


@pytest.mark.parametrize("module", [repeats, leaks, lines, urls, near])
def test_empty_tables(spark, empty, module):
    assert module.query(spark, empty).count() == 0


def test_near_odd_rows(spark, small):
    got = sorted(near.query(spark, small).select("doc_id", "n_shingles", "component_id", "kept").collect(), key=repr)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[8]] == [(297, 7, False)] and len(by[9]) == 2 and by[9][0].component_id == 7
    assert by[4][0].component_id == 4 and by[5][0].component_id == 4 and not by[5][0].kept
    assert all(r.kept and r.component_id is None for r in by[None]) and by[0][0].n_shingles == 0 and by[1][0].kept
    kept = near.keep_one(spark.read.parquet(f"{small}/documents.parquet"))
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 8 not in ids and 9 not in ids and ids.count(3) == 2 and kept.columns[2:] == ["hash", "id", "words", "kept"]


def test_rows_that_share_an_id_are_compared_by_their_own_texts(spark, tmp_path):
    one, two = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, one), (5, two), (6, one + " x"), (7, two + " x"), (8, "y " + two), (5, two)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.component_id) for r in near.query(spark, str(tmp_path)).collect())
    linked = dict(got)
    assert len(got) == 6 and {linked[6], linked[7], linked[8]} <= {5, 6, 7} and linked[7] == linked[8]


def test_large_groups_of_near_copies(spark, tmp_path):
    """Copies that are linked over a hub, and copies that are close to each other and not linked."""
    import random

    rng = random.Random(5)
    texts = []
    for base, changes, n in ((0, 4, 60), (1, 7, 60), (2, 12, 60)):
        words = [f"b{base}x{i}" for i in range(200)]
        texts.append(" ".join(words))
        for _ in range(n):
            copy = list(words)
            for k in rng.sample(range(200), changes):
                copy[k] = f"r{rng.random()}"
            texts.append(" ".join(copy))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.component_id for r in near.query(spark, str(tmp_path)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 50


def test_lines_can_keep_the_first(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {r.doc_id: r.text for r in lines.drop_lines(docs.where("doc_id >= 20"), keep_first=True).collect()}
    assert out[20].startswith("Same line\n") and out[21].startswith("own 1")


def test_removed_passages_leave_no_window(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    clean = leaks.remove(docs, items)
    assert leaks.digests(clean, items).where("contaminated").count() == 0
    texts = {r.doc_id: r.text for r in clean.where("doc_id IN (7, 13)").collect()}
    assert texts[7].startswith("w0 w1 w2 w3 w4 ") and " w17 " in texts[7] and "w10 " not in texts[7] and 13 not in texts  # mostly benchmark
    found = {r.doc_id: r["items"] for r in leaks.find(docs.drop("hash"), items).collect()}
    assert found[7] == ["0", "10"]


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet").where("doc_id IS NOT NULL"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(map(repr, leaks.digests(docs, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 8)
    assert sorted(map(repr, leaks.digests(docs, items).collect())) == whole

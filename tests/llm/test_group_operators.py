"""Operators on groups of documents, against SQL or plain versions."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lastseen.llm import line_dedup, mixing, near_dup, quality_model, topk
from lastseen.llm.common import HANDED_ROWS, ship, stored
from lastseen.llm.registry import ORACLES, QUERIES
from tests.llm.corpus import WORD, awkward, documents, empty, pairs_of, prose

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ship(spark)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    with duckdb.connect() as connection:
        for table in ("documents", "embeddings"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        result = connection.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        expected = sorted(result.fetchall(), key=repr)
    frame = QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(columns)
    assert pairs_of(frame, *columns) == expected and expected


# --- near duplicates -------------------------------------------------------------


def plain_groups(rows, words, percent):
    sets = {}
    for doc_id, text in rows:
        found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        k = min(words, len(found))
        sets[doc_id] = {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if k else set()
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def family(base, seed, edits):
    words = prose(base, 120).split()
    chance = np.random.default_rng(seed)
    for at in chance.choice(len(words), edits, replace=False):
        words[at] = prose(10_000 + seed, 1) + str(at)
    return " ".join(words)


def test_near_copies_of_every_degree(spark):
    """Families about the threshold: linked through the middle, chains, outsiders."""
    rows = [(i, family(50 + i % 3, i, i % 9)) for i in range(120)]
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (502, ""), (503, None), (504, "one two"), (505, "One  TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        got = pairs_of(near_dup.near_groups(docs, words, percent), "doc_id", "n_shingles", "component_id", "kept")
        assert got == sorted(plain_groups(rows, words, percent), key=repr)


def test_near_copies_on_awkward_and_empty(spark):
    docs = awkward(spark)
    groups = near_dup.near_groups(docs).collect()
    assert len(groups) == docs.count()
    assert all(g["kept"] and g["component_id"] is None for g in groups if g["doc_id"] is None)
    assert {g["component_id"] for g in groups if g["doc_id"] in (5, 6, 7)} == {5}
    kept = near_dup.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert near_dup.near_groups(empty(spark)).count() == 0


def test_odd_sketches_estimate_similarity():
    chance = np.random.default_rng(5)
    pool = chance.integers(0, 2**64, 3000, dtype=np.uint64)
    for shared in (2400, 2700, 2950):
        one, other = pool[:shared], pool
        samples = [near_dup.min_hashes(x, near_dup.FINE_SAMPLES) for x in (one, other)]
        x, y = (near_dup.odd_sketch(s, near_dup.FINE_BITS) for s in samples)
        differing = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        bits = near_dup.FINE_BITS
        found = 1 + bits / (4 * near_dup.FINE_SAMPLES) * np.log(1 - 2 * differing / bits)
        assert abs(found - shared / 3000) < 0.05


def test_whole_sketches_rule_out_no_link(spark):
    """The test of whole sets keeps every link, and little else about the threshold."""
    chance = np.random.default_rng(11)
    rows = []
    for size in (1, 7, 40, 300, 2500, 30_000):
        for edits in {0, 1, size // 14, size // 13, size // 12, size // 11, size // 9}:
            one = np.unique(chance.integers(0, 2**64, size, dtype=np.uint64))
            other = np.concatenate((one[edits:], chance.integers(0, 2**64, edits, dtype=np.uint64)))
            linked = 100 * (size - edits) >= 85 * (size + edits)
            sketches = [near_dup.whole_sketch(x).tolist() for x in (one, other)]
            rows.append((size, linked, *sketches, size, len(other)))
    frame = spark.createDataFrame(rows, "n int, linked boolean, a array<long>, b array<long>, x long, y long")
    kept = frame.select("n", "linked", near_dup.may_link("a", "b", "x", "y", 85).alias("kept")).collect()
    assert all(r["kept"] for r in kept if r["linked"])
    assert sum(r["kept"] for r in kept if not r["linked"] and r["n"] <= 2500) <= 4


def test_dense_groups_below_the_threshold_stay_apart(spark):
    """Many texts that are all alike, but not enough, and links among some of them."""
    rows = [(i, family(7, 100 + i, 5)) for i in range(150)]
    rows += [(500 + i, family(7, 100 + i, 5) + f" end{i}") for i in range(0, 150, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs_of(near_dup.near_groups(docs, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(plain_groups(rows, 3, 85), key=repr)


def test_components_of_a_chain_and_a_star(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([101 + i])) for i in range(30)]
    labels = near_dup.components(spark.createDataFrame(links, "a binary, b binary"))
    assert {bytes(r["root"]) for r in labels.collect()} == {bytes([0]), bytes([100])}
    more = spark.createDataFrame([(bytes([40]), bytes([101])), (bytes([200]), bytes([201]))], "a binary, b binary")
    joined = {bytes(r["node"]): bytes(r["root"]) for r in near_dup.merged(labels, more).collect()}
    assert joined[bytes([130])] == bytes([0]) and joined[bytes([201])] == bytes([200])
    assert len(joined) == 74


# --- lines, mixing ---------------------------------------------------------------


def test_lines_on_many_sites_go_but_copies_stay(spark):
    notice = "Read our notice"
    rows = [(i, f"{prose(i, 20)}\n  {notice} \n\n{prose(90 + i, 9)}", f"s{i % 6}") for i in range(12)]
    rows += [(50 + i, prose(7, 30), f"s{i}") for i in range(6)] + [(60, None, "s1"), (61, notice, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.without_boilerplate(docs).collect()}
    assert len(out) == len(rows)
    assert all(notice not in out[i]["text"] and out[i]["n_removed"] == 1 for i in range(12))
    assert out[0]["text"] == f"{prose(0, 20)}\n\n{prose(90, 9)}"
    assert all(out[50 + i]["text"] == prose(7, 30) for i in range(6))
    assert out[60]["text"] is None and out[61]["text"] == notice


def test_boilerplate_leaves_pages_it_dominates_and_copies_keep_their_lines(spark):
    notice = [prose(5, 24), prose(6, 20)]
    article = [prose(100 + k, 30) for k in range(10)]
    # Pages the notice dominates, and no other page has it.
    rows = [(i, "\n".join([prose(200 + i, 14), *notice]), f"s{i % 6}") for i in range(12)]
    # Copies with another word each, so that nine lines of ten are on six sources.
    rows += [(50 + i, "\n".join([*article[:i], f"{article[i]} x{i}", *article[i + 1 :], notice[0]]), f"s{i}") for i in range(6)]
    rows += [(70 + i, "\n".join(notice), f"s{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.without_boilerplate(docs).collect()}
    assert all(out[i]["text"] == prose(200 + i, 14) and out[i]["n_removed"] == 2 for i in range(12))
    assert all(out[i]["n_removed"] == 1 and out[i]["text"] == t.rsplit("\n", 1)[0] for i, t, _ in rows[12:18])
    assert all(out[i]["n_removed"] == 0 and out[i]["text"] == t for i, t, _ in rows[18:])


def test_lines_on_awkward_and_empty(spark):
    docs = awkward(spark)
    out = line_dedup.without_boilerplate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    assert out.filter("n_removed > 0").count() >= 8
    assert line_dedup.without_boilerplate(empty(spark)).count() == 0


def test_mix_meets_its_targets(spark):
    docs = documents(spark, "sf0.01")
    rows = mixing.mixed(mixing.sized_documents(docs, "doc_id")).collect()
    by_source = {}
    for row in rows:
        taken = row["epochs"] * row["size"] + row["extra"]
        assert 0 <= taken <= 2 * row["size"]
        target, total = by_source.get(row["source"], (row["target"], 0))
        by_source[row["source"]] = (target, total + taken)
    assert all(abs(total - target) <= 1 for target, total in by_source.values())
    assert abs(sum(t for t, _ in by_source.values()) - 1.5 * sum(r["size"] for r in rows)) < 1


def test_targets_are_shared_by_weight_below_the_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 40)], "source string, source_size long")
    target = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a and null are full, the rest share 3075 - 100 by 2 to 1.
    assert target["a"] == 20 and target[None] == 80
    assert target["b"] == pytest.approx(1983.33, abs=0.01) and target["c"] == pytest.approx(991.67, abs=0.01)


def test_mixed_documents_on_awkward_and_empty(spark):
    docs = awkward(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= docs.count() / 2
    assert mixing.mixed_documents(empty(spark)).count() == 0


# --- quality model ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    frame = quality_model.op3_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = frame.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(held) > 50
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_model_without_labels_and_on_awkward(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.trained(docs, none)
    scores = quality_model.scored(docs, model)
    assert scores.count() == docs.count() and scores.filter("quality_score != 0.5").isEmpty()
    some = spark.createDataFrame([(3, 0), (5, 1), (9, 1), (12, 0), (5, None), (None, 1), (7777, 1)], "doc_id long, quality int")
    kept = quality_model.scored(docs, quality_model.trained(docs, some), least=0.0)
    assert kept.count() == docs.count() and "text" in kept.columns
    assert quality_model.scored(empty(spark), model).count() == 0


def test_model_learns_an_interaction():
    chance = np.random.default_rng(2)
    values = chance.random((4000, len(quality_model.STATISTICS)))
    labels = ((values[:, 2] > 0.5) != (values[:, 5] > 0.5)).astype(float)
    model = quality_model.fit(values[:3000], labels[:3000])
    assert (2, 5) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(values[3000:]) >= 0.5) == labels[3000:]).mean() > 0.9


# --- top k -----------------------------------------------------------------------


def test_topk_with_ties_nulls_and_large_values(spark):
    chance = np.random.default_rng(3)
    rows = [(i, chance.integers(-3, 4, 33).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 33)]
    rows += [(403, [float("inf")]), (404, []), (405, [1.0]), (None, [1.0] * 33), (406, [3e7] * 33), rows[7], rows[7]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.nearest(frame.filter("vec_id % 20 = 0"), frame, 20, 64.0)
    usable = {
        i: [int(np.floor(64 * x)) for x in v]
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    expected = []
    for q in usable:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(usable[q], usable[c])), c) for c in usable if c != q)
            expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:20])]
    assert pairs_of(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)
    nothing = frame.limit(0)
    assert topk.nearest(nothing, nothing, 20, 64.0).count() == 0


@pytest.mark.parametrize("large", [2.0**28, 2.0**46, 2.0**54])
def test_topk_with_queries_of_large_components(spark, large, monkeypatch):
    """Products beyond 53 and 64 bits, in queries and candidates; what does not fit is left out."""
    monkeypatch.setattr(topk, "QUERIES_AT_A_TIME", 7)
    chance = np.random.default_rng(4)
    rows = [(i, chance.integers(-3, 4, 20).astype(float).tolist()) for i in range(200)]
    rows += [(i, (large * chance.integers(-2, 3, 20)).tolist()) for i in range(200, 260)]
    rows += [(260, [1e30] * 20), (280, [2.0**57] * 20), (300, [1e308, float("-inf")]), rows[3], rows[220], rows[220]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.nearest(frame.filter("vec_id % 20 = 0"), frame, 20, 64.0)
    usable = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i < 260}
    expected, most = [], 2**63 - 1
    for q in usable:
        if q % 20 == 0:
            sums = {c: sum(a * b for a, b in zip(usable[q], usable[c])) for c in usable if c != q}
            best = sorted((-max(-most, min(most, s)), c) for c, s in sums.items())[:20]
            expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert pairs_of(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=repr)


# --- pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, SMALL), f"test-{name}")
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "quality":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0")
            assert docs.join(labels, "doc_id").count() <= 0.1 * labels.count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            expected = [i for i, _, _, kept in plain_groups(rows, 5, 80) if kept]
            assert sorted(r["doc_id"] for r in docs.collect()) == expected
        if name == "mix":
            assert set(pairs_of(docs, *docs.columns)) <= set(pairs_of(before, *docs.columns))
            assert docs.count() > before.count()
    assert docs.count() == before.count() and docs.filter("n_tokens * 4 != length(ids)").isEmpty()


def test_pipeline_on_awkward_and_empty(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        docs.agg(F.sum("n_tokens")).collect()


def test_pipeline_hands_workers_few_rows_at_once(spark, tmp_path, monkeypatch):
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    def counted(spark, docs, sf_dir):
        return docs.coalesce(1).mapInArrow(work, "rows long")

    spark.range(2 * HANDED_ROWS + 1).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("counted", counted)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [row["rows"] for row in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found) == [1, HANDED_ROWS, HANDED_ROWS]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

"""Operators on single texts and on repeated bytes, against plain versions."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lastseen.llm import byte_pair, outliers, personal_data, prefix_free, token_files
from lastseen.llm.chunks import ChunkEncoder
from lastseen.llm.common import scratch_path, ship
from tests.llm.corpus import SCHEMA, WORD, awkward, awkward_rows, documents, empty, pairs_of, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ship(spark)


@pytest.fixture(scope="module")
def corpora(spark):
    return [awkward(spark), documents(spark), empty(spark)]


# --- personal data ---------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if is_valid(kind, m.group())
    ]


def luhn_card(stem):
    return next(f"{stem}{d}" for d in range(10) if is_valid("card", f"{stem}{d}"))


WORDS = ("und", "das", "ist", "so")
CARDS = [luhn_card(str(4_310_082_329_322_59 + 7_919 * i).zfill(15)) for i in range(20)]

TRICKY = [
    "a@b.c_d@e.f",
    "..@a.b a@@b.c a@b..c -@-.- x@y.z@w.v",
    "1.2.3.4.5.6.7.8 01.002.000255.4 256.1.1.1 1.2.3",
    "4310082329322593 4310-0823 2932-2593 4310  0823 2932 2593 43100823293225934310082329322593",
    "+1 (255) 555-8013+33 1.22.33 +1-2 +()12345678 ++12345678",
    "9" * 5000 + " " + "x" * 5000,
    "é" * 7 + "a@b.de",
]


def test_base_spans_and_digest(spark, corpora):
    rows = [(i, text, *[None] * (len(SCHEMA) - 2)) for i, text in enumerate(TRICKY)]
    for docs in (*corpora, spark.createDataFrame(rows, SCHEMA)):
        found = personal_data.personal_spans(docs, "doc_id", "text").collect()
        assert len(found) == docs.count()
        for row in found:
            spans = [(k, s["start"], s["end"]) for k in personal_data.KINDS for s in row[k]]
            assert spans == base_spans(row["text"])
            for span in row["added"]:
                assert all(span["end"] <= a or span["start"] >= b for _, a, b in spans)


def test_query_digest(spark):
    frame = personal_data.op1_personal_data(spark, "/root/testdata/sf0.001")
    texts = {row["doc_id"]: row["text"] for row in documents(spark).collect()}
    for row in frame.collect():
        listed = [f"{k}:{a}:{b}" for k, a, b in base_spans(texts[row["doc_id"]])]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row["spans"].split(",")) | {""} or not listed
        for kind in personal_data.KINDS:
            assert row[f"n_{kind}"] == sum(x.startswith(kind) for x in listed)


def test_obfuscated_forms_are_found_once_learned(spark):
    lines = [f"write to {n}.{n}@mail{n}.example.com please" for n in ("ana", "bo", "cy", "di")]
    rows = [(i, lines[i % 4]) for i in range(60)] + [(100 + i, f"see at x{i} at page") for i in range(20)]
    rows += [(200, "write to joe [at] mail9 [dot] example [dot] com please"), (201, "nothing at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r["doc_id"]: r["added"] for r in personal_data.personal_spans(docs, "doc_id").collect()}
    assert [tuple(s) for s in added[200]] == [(9, 47, 0)]
    assert added[201] == []


def test_numbers_that_a_longer_match_swallows_are_added(spark):
    """The base rules take two numbers as one and drop it; the trees learned from others."""
    cards = [CARDS[i % len(CARDS)] for i in range(240)]
    rows = [(i, f"die {card} {WORDS[i % 4]}") for i, card in enumerate(cards)]
    rows += [(1000 + i, f"die {int(card) ^ 1:016d} {WORDS[i % 4]}") for i, card in enumerate(cards)]
    rows += [(2000 + i, f"die +1 ({200 + i}) 555-{8000 + i} {WORDS[i % 4]}") for i in range(240)]
    rows += [
        (5500, f"die {CARDS[0]} {CARDS[1]} ende"),
        (5501, f"die {CARDS[0]} {int(CARDS[1]) ^ 1:016d} ende"),
        (5502, "die +1 (826) 555-4081 190.137.223.204 ende"),
        (5503, f"die {int(CARDS[0]) ^ 1:016d} {int(CARDS[1]) ^ 1:016d} ende"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data.personal_spans(docs, "doc_id", "text").collect()
    added = {r["doc_id"]: [(personal_data.KINDS[k], r["text"][a:b]) for a, b, k in r["added"]] for r in found}
    assert sorted(added[5500]) == sorted(("card", c) for c in CARDS[:2])
    assert added[5501] == [("card", CARDS[0])]
    assert added[5502] == [("phone", "+1 (826) 555-4081")]
    assert added[5503] == []
    assert not any(added[i] for i in added if i < 5500)


def test_added_spans_of_the_driver_table(spark):
    """Every added card passes the checksum, and each is a part of a match that was dropped."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = personal_data.personal_spans(docs, "doc_id", "text").filter("size(added) > 0").collect()
    added = [(r["text"], a, b, personal_data.KINDS[k]) for r in found for a, b, k in r["added"]]
    assert {kind for *_, kind in added} == {"card", "phone"}
    expected = set()
    for text in {r["text"] for r in docs.select("text").collect() if r["text"]}:
        base = base_spans(text)
        for kind, pattern in (("card", r"(?<![0-9])[0-9]{16}(?![0-9])"), ("phone", r"\+1 \([0-9]{3}\) 555-[0-9]{4}")):
            for m in re.finditer(pattern, text):
                free = all(m.end() <= a or m.start() >= b for _, a, b in base)
                if free and (kind == "phone" or is_valid("card", m.group())):
                    expected.add((text, m.start(), m.end(), kind))
    assert set(added) == expected


def test_personal_data_clashing_names(spark, corpora):
    with pytest.raises(ValueError):
        personal_data.personal_spans(corpora[0].withColumnRenamed("source", "phone"), "doc_id", "phone")


def test_trees_separate_and_calibrate():
    cells = [dict.fromkeys(personal_data.FEATURES, 0) | {"kind": 2, "check": c, "yes": 90 * c, "no": 50 * (1 - c)} for c in (0, 1)]
    trees = personal_data.Trees(cells)
    limits = personal_data.calibrated(trees, cells)
    assert trees.score(cells[0]) < limits[2] <= trees.score(cells[1])
    assert limits[0] == float("inf")


# --- quality rules ---------------------------------------------------------------


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(corpora):
    for docs in corpora:
        for row in outliers.text_statistics(docs, "doc_id", "text").collect():
            assert tuple(row)[2:7] + (row["base_failed"],) == plain_statistics(row["text"])


def mcd(vectors):
    """FAST-MCD with the operator's start and steps, in numpy."""
    floors = np.array(list(outliers.STATISTICS.values())) * outliers.SCALE
    x = vectors.astype(np.float64)

    def bulk(distance):
        rank = np.minimum(np.floor(np.log1p(distance) * 200 + 0.5), 4000).astype(int)
        return x[rank <= np.ceil(np.percentile(rank, 75))]

    q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
    part = bulk(4 * (np.abs(x - q2) / np.maximum(q3 - q1, floors)).max(axis=1))
    for step in range(outliers.STEPS + 1):
        centre = part.mean(axis=0)
        scatter = (part.T @ part / len(part) - np.outer(centre, centre)) * outliers.CONSISTENCY
        inverse = np.linalg.inv(scatter + np.diag(floors**2))
        distance = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        part = bulk(distance)
    return distance


def test_outliers_match_plain_mcd(spark):
    rows = [(i, prose(i, 30 + i % 40), "en", "a") for i in range(150)]
    rows += [(500 + i, " ".join(f"{w}$%&" for w in prose(i, 60).split()), "en", "a") for i in range(6)]
    rows += [(900 + i, prose(i, 50), None, f"few{i}") for i in range(5)] + [(999, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    statistics = outliers.text_statistics(docs, "doc_id", "lang", "source").cache()
    judged = {r["doc_id"]: r for r in outliers.judged(statistics).collect()}
    assert len(judged) == len(rows)
    vectors = outliers.with_vector(statistics).filter("source = 'a' and not base_failed").orderBy("doc_id").collect()
    expected = mcd(np.array([[v[name] for name in outliers.STATISTICS] for v in vectors]))
    got = np.array([judged[v["doc_id"]]["distance"] for v in vectors])
    assert np.allclose(got, expected, rtol=1e-6)
    assert all(judged[i]["kept"] for i in range(150))
    assert not any(judged[500 + i]["kept"] for i in range(6))
    # Too few documents to estimate anything, even together.
    assert all(judged[900 + i]["kept"] for i in range(5)) and not judged[999]["kept"]


def test_a_small_pool_is_judged_by_its_language_or_by_all(spark):
    marked = lambda k: " ".join(f"{w}$%&" for w in prose(k, 60).split())
    rows = [(i, prose(i, 30 + i % 40), "en", "a") for i in range(150)]
    rows += [(500 + i, prose(900 + i, 50), ("en", "fr", None)[i % 3], f"few{i}") for i in range(9)]
    rows += [(600 + i, marked(i), ("en", "fr", None)[i % 3], f"odd{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = outliers.judged(outliers.text_statistics(docs, "doc_id", "lang", "source")).collect()
    assert len(judged) == len(rows) and all(r["distance"] is not None for r in judged)
    assert {r["doc_id"] for r in judged if not r["kept"]} == {600 + i for i in range(6)}


def test_outliers_do_not_depend_on_row_order(spark):
    docs = documents(spark)
    one = outliers.judged(outliers.text_statistics(docs, "doc_id", "lang", "source"))
    other = outliers.judged(
        outliers.text_statistics(docs.orderBy(F.rand(3)).repartition(13), "doc_id", "lang", "source")
    )
    assert pairs_of(one, "doc_id", "distance", "kept") == pairs_of(other, "doc_id", "distance", "kept")


def test_quality_rules_on_awkward_and_empty(corpora):
    for docs in (corpora[0], corpora[2]):
        judged = outliers.judged(outliers.text_statistics(docs, "doc_id", "lang", "source"))
        assert judged.count() == docs.count()
        assert judged.filter("kept is null").isEmpty()


def test_quality_rules_are_native(spark):
    for build in (outliers.op9_quality_rules, personal_data.op1_personal_data):
        plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- repeated bytes --------------------------------------------------------------


def plain_removal(texts):
    data = [(text or "").encode() for text in texts]
    counts = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - 399):
            if counts[d[i : i + 400]] > 1:
                covered[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, gone in zip(d, covered) if not gone)
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_removal(docs):
    rows = docs.select("doc_id", "text").collect()
    expected = plain_removal([row["text"] for row in rows])
    got = prefix_free.repeated_spans(docs)
    assert "spans" in got.columns and len(set(got.columns)) == len(got.columns)
    got = pairs_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((row["doc_id"], *e) for row, e in zip(rows, expected)), key=repr)


def test_repeats_against_plain_search(corpora):
    for docs in corpora:
        check_removal(docs)


def test_repeats_that_end_anywhere(spark):
    """Passages of many lengths about the limit, with other text around each copy."""
    passage = prose(40, 200)
    rows = []
    for i in range(60):
        start, size = (i * 7) % 60, 380 + (i * 13) % 90
        rows.append((i, prose(100 + i, 12) + passage[start : start + size] + prose(300 + i, 12)))
    rows += [(100, "ab" * 900), (101, "ab" * 250 + "c" + "ab" * 250), (102, "é" * 450), (103, "x" * 399), (104, "x" * 400)]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("cell", [1, 3, 8, 64])
def test_many_entries_of_one_stem(spark, monkeypatch, cell):
    """The size of cells decides where windows are compared, not what is found."""
    rows = [(i, prose(100 + i, 25) + prose(41, 120)[: 410 + i % 5] + prose(300 + i, 25)) for i in range(30)]
    # Passages that begin at any place before a phrase start, so that cells are cut short.
    rows += [(100 + i, prose(500 + i, 9) + prose(42, 130)[i % 45 : 520] + prose(700 + i, 9)) for i in range(60)]
    monkeypatch.setattr(prefix_free, "CELL", cell)
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


def test_texts_of_one_id_and_of_none(spark):
    """Texts are told apart whatever their ids, also where short checksums agree."""
    one, other = "one " * 3, "two " * 3
    by_sum = {}
    for k in range(200_000):
        text = f"{k:x}"
        clash = by_sum.setdefault(zlib.crc32(text.encode()) & 0xFFFF, text)
        if clash != text:
            break
    passage = prose(60, 150)
    rows = [(None, clash + passage), (None, text + prose(61, 90)), (7, one + passage), (7, other + prose(62, 90))]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string"))


def test_thousands_of_equal_rows(spark):
    long, short = prose(70, 120), prose(71, 20)
    rows = [(None, long)] * 5_000 + [(3, long)] * 5_000 + [(None, short), (4, prose(72, 30) + long[50:700])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = prefix_free.repeated_spans(docs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    size = len(long.encode())
    found = {(r["doc_id"], r["n_bytes"], r["n_removed"]): r["count"] for r in got}
    assert found[None, size, size] == found[3, size, size] == 5_000
    assert found[None, len(short.encode()), 0] == 1
    assert [n for (i, _, n) in found if i == 4] == [len(long[50:700].encode())]


def test_planted_passages_are_removed_and_clean_texts_kept(spark):
    """Recall 1.00 by n_removed on passages of 400 bytes and more, nothing from clean texts."""
    clean = [(i, prose(2_000 + i, 150)) for i in range(120)]
    planted = []
    for i in range(60):
        passage = prose(5_000 + i % 20, 200)
        passage = passage[: 400 + 7 * (i % 20)]
        planted.append((1_000 + i, prose(3_000 + i, 40) + "|" + passage + "|" + prose(4_000 + i, 40), len(passage.encode())))
    rows = clean + [row[:2] for row in planted]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in prefix_free.repeated_spans(docs).collect()}
    assert all(found[i] == 0 for i, _ in clean)
    assert all(found[i] >= size for i, _, size in planted)


# --- tokens ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(corpora, reference):
    for docs in corpora:
        frame = byte_pair.encoded(docs.withColumn("copy", F.col("text")), RANKS, public_tokenizers.PATTERN)
        rows = frame.collect()
        assert len(rows) == docs.count() and len(set(frame.columns)) == len(frame.columns)
        for row in rows:
            text = row["copy"] or ""
            ids = np.frombuffer(row["ids"], "<u4").tolist()
            assert ids == reference.encode_ordinary(text)
            assert row["n_tokens"] == len(ids)
            assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "text",
    ["  a", "a  b", "\n\n x\n", "a \n b", " it's 'tis I'll", "  ", "\x1c a \x85 b", " lead", "trail ", "a᠎ b", "1 2  3\t4"],
)
def test_bpe_white_space(text, reference):
    codec = byte_pair.codec(RANKS, public_tokenizers.PATTERN)
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_long_pieces(reference):
    codec = byte_pair.codec(RANKS, public_tokenizers.PATTERN)
    for text in ("x" * 3000, "".join(prose(k, 200).replace(" ", "") for k in range(3))):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_chunks_are_forgotten_but_never_wrong():
    encoder = ChunkEncoder(lambda chunks: [c.encode() for c in chunks], limit=5)
    for k in range(6):
        texts = [prose(k, 9), "a  b", prose(k + 1, 3)]
        assert encoder.encode(texts) == [t.encode() for t in texts]


def test_chunks_in_bulk_equal_the_tokenizer():
    """Runs of white space, empty texts, forgotten chunks, texts of one chunk."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, _ = token_files._tokenizer(path)
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\n a \n", "x\x1c y", "a\u00a0 b \u2003 c", "é  é é", "a   "]
    texts += [prose(k, 40).replace("ta", k % 3 * " ").replace("el", "\n" * (k % 2)) for k in range(60)]
    for _ in range(2):
        for some in (texts, texts[::-1], texts[:1], []):
            ids, sizes = encoder.encode(pa.array(some, pa.string()))
            expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in some]
            assert sizes.tolist() == [len(e) for e in expected]
            assert ids.tolist() == [i for e in expected for i in e]
        encoder._limit = 3  # forgets everything between calls
    encoder._limit = 1_200_000


def test_token_files(spark, corpora, monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_AT_ONCE", 20_000)
    monkeypatch.setattr(token_files, "SEQUENCES_IN_BATCH", 2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    marks = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  <|endoftext|>  b", " <|endoftext|><|endoftext|>"]
    marked = spark.createDataFrame([(i, text) for i, text in enumerate(marks)], "doc_id long, text string")
    for docs in (*corpora, marked):
        manifest = token_files.write_token_files(docs, path, scratch_path(spark, "test-tokens"))
        got = [tuple(r) for r in token_files.read_token_files(manifest).orderBy("start").collect()]
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
        at, expected = 0, []
        for row in rows:
            ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [0]
            expected.append((row["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
            at += len(ids)
        assert got == expected
        for row in manifest.collect():
            file = token_files.TokenFile(row["tokens"], row["index"])
            assert len(file.table) == row["n_sequences"]
            assert sum(file.mask(i).sum() for i in range(row["n_sequences"])) == row["n_tokens"]
            if row["n_sequences"]:
                assert not file.sequence(0).flags.owndata and len(file.sequence(0)) == token_files.SEQUENCE_LENGTH


def test_rows_of_the_fixture():
    assert len(awkward_rows()) == 29

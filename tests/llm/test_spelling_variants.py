"""Spelling variants against a plain search over deleted letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lastseen.llm.spelling_variants import (
    counts_of,
    grown,
    letters_of,
    op13_spelling_variants,
    variants,
)
from tests.llm.corpus import SCHEMA, awkward_rows, pairs_of

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {word: n for word, n in words.items() if len(word) >= 5 and n >= 3}


def plain_variants(words):
    """Near words share a pattern with a hole, or one is the other without a letter."""
    near, holes = defaultdict(set), defaultdict(set)
    for word in words:
        for i in range(len(word)):
            holes[word[:i], word[i + 1 :]].add(word)
            shorter = word[:i] + word[i + 1 :]
            if shorter in words:
                near[word].add(shorter)
                near[shorter].add(word)
    for group in holes.values():
        for word in group:
            near[word] |= group - {word}
    forms = {}
    for word, others in near.items():
        if others:
            best = min(others, key=lambda other: (-words[other], other))
            if words[best] >= 2 * words[word]:
                forms[word] = best
    rows = []
    for word, n in words.items():
        form, root = forms.get(word), word
        while root in forms:
            root = forms[root]
        rows.append((word, form, root, n, len(near[word]), words[form] if form else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_given_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    expected = plain_variants(plain_words([tuple(row) for row in docs.collect()]))
    assert any(row[1] for row in expected)
    assert pairs_of(op13_spelling_variants(spark, f"/root/testdata/{sf}"), *COLUMNS) == expected


def invented(chance, size, letters):
    return {
        "".join(chance.choice(letters) for _ in range(chance.randint(5, 8))): chance.choice((3, 3, 4, 7, 20, 90))
        for _ in range(size)
    }


@pytest.mark.parametrize("sample, cell", [(262_144, 8_192), (600, 40), (5, 40)])
def test_many_cells_and_few_find_the_same(spark, sample, cell):
    """Few letters make dense words; a small sample plans poor cuts, which must not matter."""
    chance = random.Random(13)
    words = invented(chance, 3_000, "abeéÿ") | invented(chance, 500, "ab")
    words |= {"a" * 300: 5, "a" * 301: 50, "a" * 299 + "b": 3, "b" + "a" * 299: 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert pairs_of(variants(frame, sample, cell), *COLUMNS) == plain_variants(words)


def test_reach_prunes_no_box_it_needs():
    chance = random.Random(5)
    words = sorted(w for w in invented(chance, 2_000, "abcdef") if len(w) == 7)
    counts = counts_of(letters_of(pa.array([w.encode() for w in words]), 7))
    tree = grown(counts, 4)
    leaf_of = tree.leaf_of(counts)
    found = {(int(q), leaf) for leaf, rows in tree.reach(counts, 1) for q in rows}
    step = counts[None, :, :].astype(int) - counts[:, None, :]
    near = (np.abs(step).sum(axis=2) == 2) & (step.max(axis=2) == 1)
    for q, p in zip(*np.nonzero(near)):
        if step[q, p].argmin() < step[q, p].argmax():
            assert (int(q), int(leaf_of[p])) in found
    assert len(found) < len(words) * len(set(leaf_of.tolist())) / 2


def test_awkward_and_empty_tables(spark, tmp_path):
    rows = awkward_rows()
    rows += [(i, f"Colour colours color {'x' * 40} {'x' * 41} Élan élans ÷×÷×÷ abcde", "en", "s", 0, *["x"] * 8) for i in range(900, 1_100)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain_variants(plain_words([row[:2] for row in rows]))
    assert pairs_of(op13_spelling_variants(spark, str(tmp_path)), *COLUMNS) == expected
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op13_spelling_variants(spark, f"{tmp_path}/none").collect() == []

"""The corpus pipeline against a plain Python version, on a small corpus with planted cases."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __kept boolean, rejected boolean"
ALPHABETS = {"en": "etaoinshrdlu", "de": "zäöüßkgwbfmp"}
VOCABULARY = {lang: ["".join(random.Random(f"{lang}{i}").choices(letters, k=random.Random(i).randint(3, 8))) for i in range(300)] for lang, letters in ALPHABETS.items()}
PASSAGE = " ".join(random.Random(5).choices(VOCABULARY["en"], k=14))
ITEMS = [(1, PASSAGE), (2, None), (3, "")]


def corpus():
    draw = random.Random(1)
    text = lambda lang, n: " ".join(draw.choices(VOCABULARY[lang], k=n))
    docs = {i: (text(lang := "de" if i % 2 else "en", 1500 if i == 7 else draw.randint(40, 120)), lang) for i in range(80)}
    docs |= {100: docs[3], 101: docs[3], 102: docs[4]}  # exact copies
    docs |= {110: (docs[5][0] + " zzz", "de"), 111: ("zzz " + docs[6][0], "en")}  # near copies
    docs |= {120: (f"{docs[8][0]} {PASSAGE} {text('en', 40)}", "en"), 121: (PASSAGE, None)}
    noise = " ".join("".join(draw.choices("qxjvcy", k=6)) for _ in range(200))  # no trigrams of either language
    return docs | {130: (None, "en"), 131: ("", None), 132: (" 12 34 !!\n", "de"), 133: (noise, None)}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def plain(docs):
    """doc_id to text of what all stages but the last keep."""
    kept = {i: t for i, (t, _) in docs.items() if any(map(str.isalpha, t or "")) and i != 133}
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    group = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            a, b = shingles(kept[i]), shingles(kept[j])
            if i < j and 100 * len(a & b) >= 75 * len(a | b):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = {k: new if g == old else g for k, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    item = PASSAGE.split()
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    return {i: t for i, t in kept.items() if not windows & {tuple(t.split()[k : k + 10]) for k in range(len(t.split()) - 9)}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), None, True) for i, (t, lang) in corpus().items()], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_against_plain_python(spark, folder):
    want, pieces, room = plain(corpus()), collections.defaultdict(list), collections.defaultdict(list)
    assert not {100, 3, 4, 110, 111, 120, 121, 130, 131, 132, 133} & set(want) and {101, 102} - set(want) == set() and {5, 6, 7, 8} <= set(want)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        room[r.sequence_id].append((r.offset, r.length))
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces) == set(want)
    for i, t in want.items():
        ids, at = [*theirs.encode(t, add_special_tokens=False).ids, 2], 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    for places in room.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 1024


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name != "packing":
            assert stage(spark, docs, folder).columns == docs.columns, name

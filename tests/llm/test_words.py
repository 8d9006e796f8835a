"""What follows from equal words and ids: words that meet under a hash, rows that share an id or have none."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tidewell.llm import common, decontaminate, jaccard_join, language_id, packing

#: Words of one hash where hashes have no key.
TWINS = ["decontaminations", "khjyswwggpgaouot", "fegyvczri0kq8his"]


def test_twins_have_one_hash_without_a_key_alone():
    raw = np.frombuffer("".join(TWINS).encode(), np.uint8)
    a, b = np.array([0, 16, 32]), np.array([16, 32, 48])
    assert len(set(common.span_hashes(raw, a, b)[:2].tolist())) == 1
    assert len(set(common.keyed_hashes(raw, a, b, common.word_key()).tolist())) == 3


def test_keyed_hashes_and_comparison():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 63, 64, 65, 66, 200] for _ in range(6)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    one, two = (common.keyed_hashes(raw, starts, ends, k * 16) for k in (b"k", b"l"))
    for i, j in [(i, j) for i in range(len(words)) for j in range(len(words))]:
        assert (one[i] == one[j]) == (two[i] == two[j]) == (words[i] == words[j])
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert common.same_bytes(raw, starts[i], ends[i], raw, starts[j], ends[j]).tolist() == [words[x] == words[y] for x, y in zip(i, j, strict=True)]


def meeting(data, starts, ends, key, real=common.keyed_hashes):
    """Hashes under which all words of a length and first letter meet."""
    return np.array([int(b - a) * 256 + int(data[a]) for a, b in zip(starts, ends, strict=True)], np.uint64)


def test_packing_of_words_that_meet(monkeypatch):
    texts = [*TWINS, " ".join(TWINS), "the cat then the car", "cat car can"] * 2
    coder = packing.WordTokens(packing.default_tokenizer())
    want = [x.tolist() for x in coder.plain(texts)]
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == want
    monkeypatch.setattr(packing, "keyed_hashes", meeting)
    coder.forget()
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == want


def test_decontamination_of_words_that_meet(monkeypatch):
    items = [("a", TWINS[0]), ("b", f"one {TWINS[1]} two"), ("c", "cat"), ("d", "the car")]
    texts = [f"x {TWINS[2]} y", f"say {TWINS[0]}", f"one {TWINS[0]} two", "can cot cat", "the cat the car"]

    def found():
        w = decontaminate.windows_of(items)
        counts, row, _, _, which = decontaminate.search_shard(w, *decontaminate.text_buffers(pa.array(texts, pa.large_string())))
        return counts.tolist(), sorted({(r, w.ids[w.items[k]]) for r, k in zip(row.tolist(), which.tolist(), strict=True)})

    want = ([3, 2, 3, 3, 4], [(1, "a"), (2, "a"), (3, "c"), (4, "c"), (4, "d")])
    assert found() == want
    real, weak = common.keyed_hashes, []

    def at_first(data, starts, ends, key):
        weak.append(key)
        return meeting(data, starts, ends, key) if key == weak[0] else real(data, starts, ends, key)

    for module in (common, decontaminate):
        monkeypatch.setattr(module, "keyed_hashes", at_first)
    assert found() == want and len(set(weak)) > 1
    # the benchmark alone was hashed well, the shard's words meet
    w = decontaminate.windows_of(items)
    w.key, w.vocabulary = weak[0], meeting(w.letters, w.cuts[:-1], w.cuts[1:], None)
    decontaminate_found = decontaminate.search_shard(w, *decontaminate.text_buffers(pa.array(texts, pa.large_string())))
    assert sorted({(r, w.ids[w.items[k]]) for r, k in zip(decontaminate_found[1].tolist(), decontaminate_found[4].tolist(), strict=True)}) == want[1]


def test_jaccard_of_twins(spark):
    rows = [(i, f"one two {w} four five") for i, w in enumerate(TWINS)]
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0, 1, 2}


@pytest.mark.parametrize("ids", ["null", "same"])
def test_near_copies_of_one_id(spark, monkeypatch, ids):
    """Rows grow with the rows, not with their square."""
    words = [f"w{k}" for k in range(60)]
    rows = [(None if ids == "null" else 7, " ".join([*words, f"end{i}"])) for i in range(400)]
    seen = []
    real = jaccard_join.sets_again

    def counted(docs, wanted, shingles):
        out = jaccard_join.written(real(docs, wanted, shingles), "counted")
        asked = wanted.count()
        few = docs.select(jaccard_join.F.col("doc_id").alias("rep"), jaccard_join.text_hash()).join(wanted, ["rep", "th"]).count()
        seen.append((asked, few, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "sets_again", counted)
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 400 and len({r.component_id for r in out}) == 1
    assert all(a == b == c <= 400 for a, b, c in seen) and max(a for a, _, _ in seen) == 400


def test_language_sample_with_null_and_hot_ids(spark, monkeypatch):
    word = {"en": "the cat and", "fr": "le chat et"}
    rows = [(None if i < 1500 else 5 if i < 2500 else i, f"{word[lang]} {i} " * 3, lang) for i in range(4000) for lang in ("en", "fr")]
    rows += [(None, "the same text", "en")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = language_id.examples
    monkeypatch.setattr(language_id, "examples", lambda *a: seen.append(1) or real(*a))
    data = language_id.sampled_examples(df, "lang", 100, 14)
    per = {lang: len({row for row, x, _, _ in data if x == lang}) for lang in word}
    assert all(40 <= n <= 100 for n in per.values())  # whole rows, of many texts, whatever their ids

"""Each operator on nulls, empty tables, repeated rows, clashing columns and very long texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cubelark.llm import ngram_join, quality_crf
from cubelark.llm.chat_rotation import rotated
from cubelark.llm.decontaminate import contaminated, decontaminate
from cubelark.llm.exact_dedup import duplicate_groups, exact_dedup
from cubelark.llm.kd_shards import kd_shards
from cubelark.llm.license_scan import TEMPLATES, library_in, scan
from cubelark.llm.line_templates import drop_recurring_lines
from cubelark.llm.ngram_join import jaccard_components, near_duplicate_filter
from cubelark.llm.quality_crf import Crf, classified, quality_filter
from cubelark.llm.queries import tokenizer_file
from cubelark.llm.sentencepiece_viterbi import decode_documents, encode_documents, read_model, round_trips
from cubelark.llm.simple8b import encode_to_index
from cubelark.llm.store import join_hot, numbered

PLAIN = "doc_id long, text string"
#: Names that operators use inside, or used to.
CLASHING = "_doc doc DOC_ _lines _dropped _gone gone _bad _id id own sha key n label bucket component _maybe shard node size tie".split()
ITEM = "the harbour master counted seventeen empty barrels before the tide went out again"
BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, "All rights reserved.\nshared line one\n" + BASE), (2, "All rights reserved.\nshared line one\nanother end here"), (3, BASE + " tail"), (3, BASE + " tail"), (4, None), (None, None), (None, BASE + " tail"), (5, ""),
    (6, " \n\t"), (7, "note: " + ITEM.upper()), (8, "What is the capital of Peru?"), (9, "é ü 日本語 🎉"), (9, "another text of the same number"), (10, "one"),
]


def plain(spark, rows=ROWS):
    return spark.createDataFrame(rows, PLAIN)


def clashing(spark, rows=ROWS):
    names = [c for c in CLASHING if c != "DOC_"]
    return spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], PLAIN + "".join(f", {c} long" for c in names))


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id long, quality int")


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "what is the capital of peru"), (2, None), (None, ""), (3, "one two")], "item_id long, text string")


def sp_model():
    return read_model(tokenizer_file("piece_bpe_32k.model"))


def word_model():
    return read_model(tokenizer_file("word_bpe_49k.json"))


OPERATORS = {
    "classified": lambda d: classified(d, labels(d.sparkSession)),
    "lines": lambda d: drop_recurring_lines(d).select("doc_id", "text", F.col("_lines").alias("l"), F.col("_dropped").alias("k")),
    "licences": scan,
    "groups": duplicate_groups,
    "exact": exact_dedup,
    "contaminated": lambda d: contaminated(d, bench(d.sparkSession)),
    "clean": lambda d: decontaminate(d, bench(d.sparkSession)),
    "tokens": lambda d: encode_to_index(d, word_model()).drop("start"),
    "join": jaccard_components,
    "near": near_duplicate_filter,
    "pieces": lambda d: round_trips(d, sp_model()),
    "shards": lambda d: kd_shards(d.select("*", F.lit("s").alias("source"), F.lit("en").alias("lang")), shards=2).drop("slot", "shard"),
}


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_and_empty_tables(spark, name):
    run = OPERATORS[name]
    want = run(plain(spark))
    got = run(clashing(spark))
    rows = rows_of(want, want.columns)
    assert rows_of(got, want.columns) == rows
    if name in {"classified", "lines", "groups", "tokens", "join", "pieces", "shards"}:
        assert len(rows) == len(ROWS)
    if name not in {"near", "exact"}:
        assert run(plain(spark, [])).count() == 0
    kept = {c for c in CLASHING if c != "DOC_"} & set(got.columns) - set(want.columns)
    if kept:
        assert {r[0] for c in kept for r in got.select(c).distinct().collect()} == {7}


def test_edge_rows_have_the_documented_results(spark):
    df = plain(spark)
    exact = rows_of(exact_dedup(df), ["doc_id", "text"])
    assert (None, None) in exact and (5, "") not in exact and exact.count((3, BASE + " tail")) == 2 and (None, BASE + " tail") in exact
    groups = {(r["doc_id"], r["text_sha256"]): r for r in duplicate_groups(df).collect()}
    tail = hashlib.sha256((BASE + " tail").encode()).hexdigest()
    assert groups[None, tail]["kept"] is False and groups[3, tail]["kept"] is True and groups[3, tail]["group_size"] == 3
    only = {r["kept"] for r in duplicate_groups(plain(spark, [(None, "a"), (None, "a")])).collect()}
    assert only == {True}
    near = rows_of(near_duplicate_filter(df), ["doc_id", "text"])
    assert (9, "é ü 日本語 🎉") in near and (None, None) in near and len(near) == len(ROWS) - 2  # of 1 and 3 the first stays
    lines = {r["doc_id"]: r["text"] for r in drop_recurring_lines(df).collect() if r["doc_id"]}
    assert lines[1] == ROWS[0][1] and lines[2] == "another end here" and lines[4] is None
    clean = {r["doc_id"] for r in decontaminate(df, bench(spark)).collect()}
    assert clean == {1, 2, 3, 4, 5, 6, 9, 10, None}
    found = {(r["doc_id"], r["item_id"]): r for r in contaminated(df, bench(spark)).collect()}
    assert set(found) == {(7, 1), (8, 2)} and (found[8, 2]["start"], found[8, 2]["stop"], found[8, 2]["edits"]) == (1, 28, 0)


LONG = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(5 << 20))


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"tokens", "exact", "near", "shards"}))
def test_a_text_of_five_megabytes_without_spaces(spark, name):
    rows = [(1, LONG), (2, "plain words here"), (3, LONG[: len(LONG) // 2] + "\n" + LONG[len(LONG) // 2 :])]
    out = OPERATORS[name](plain(spark, rows))
    if name in {"lines", "clean"}:
        assert {r["doc_id"]: len(r["text"]) for r in out.collect()} == {i: len(t) for i, t in rows}
    elif name in {"contaminated", "licences"}:
        assert out.count() == 0
    else:
        assert out.count() == 3


def test_tokens_of_a_long_text(spark):
    from tokenizers import Tokenizer

    text = LONG[: 1 << 19]
    got = encode_to_index(plain(spark, [(1, text), (2, None)]), word_model()).collect()
    want = len(Tokenizer.from_str(word_model().decode()).encode(text, add_special_tokens=False).ids) + 1
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in got} == {(1, 0, want), (2, want, 1)}


def test_long_chunks_are_segmented_as_in_one_run(spark):
    import pyarrow as pa

    from cubelark.llm import sentencepiece_viterbi as sv
    from cubelark.llm import text as tx

    a, rng = sv.automaton(sp_model()), random.Random(2)
    texts = ["".join(rng.choice(signs) for _ in range(3000)) for signs in ("日本語の文章は空白がない", "abcdefghij0123456789", "etaoin", "é🎉x")] + ["x" * 5000, " " * 4000, "tion" * 900]
    for t in texts:
        buf, offs = sv.prepared(*tx.utf8(pa.array([t])))
        assert sv.encode(a, buf, offs)[0].tolist() == sv._segment_long(a, buf.tobytes().replace(b" ", sv.SPACE_MARK))
    df = plain(spark, list(enumerate(texts)))
    assert {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(df, sp_model()), sp_model()).collect()} == dict(enumerate(texts))


def test_scores_depend_on_the_text_alone(spark):
    rng = random.Random(3)
    texts = ["two\nthree four", "one\ntwo", "hello world", "world", ""] + ["\n".join(" ".join(rng.choice("Aa1|! b.").strip() or "w" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = list(enumerate(texts))
    mark = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality_crf.train(plain(spark, rows), mark)
    want = {r["doc_id"]: r["score"] for r in quality_crf.scores(plain(spark, rows), model).collect()}
    rng.shuffle(rows)
    for n in (1, 7):
        assert {r["doc_id"]: r["score"] for r in quality_crf.scores(plain(spark, rows).repartition(n), model).collect()} == want
    again = quality_crf.train(plain(spark, rows).repartition(5), mark)
    assert (again.weights == model.weights).all()
    assert {r["doc_id"] for r in quality_filter(plain(spark, rows), model, 0.5).collect()} == {i for i, s in want.items() if s >= 0.5}


def test_document_score_matches_plain_python():
    """Features of one line, weighting and neighbours by a plain loop; marginals by enumeration."""
    import itertools

    import numpy as np
    import pyarrow as pa

    from cubelark.llm import text as tx

    rng = np.random.default_rng(4)
    model = Crf(rng.normal(size=3 * quality_crf._WIDTH + 3).astype(np.float32) * 0.2, rng.normal(size=(2, 2)))
    texts = ["A b b\n\n12 | x!\nthe end.", "one line only", "x\ny z"]
    got, _ = quality_crf._scored(pa.array(texts), model)
    for t, score in zip(texts, got, strict=True):
        lines = [x for x in re.findall(r"[^\n]*\n|[^\n]+$", t) if x.strip()]
        own = [quality_crf.line_features(*tx.utf8(pa.array([x])))[0][0].astype(float) for x in lines]
        zero, w, wide = np.zeros(quality_crf._WIDTH), model.weights.astype(float), quality_crf._WIDTH
        logit = [
            own[i] @ w[:wide] + (own[i - 1] if i else zero) @ w[wide : 2 * wide] + (own[i + 1] if i + 1 < len(own) else zero) @ w[2 * wide : 3 * wide] + w[-3] * (i == 0) + w[-2] * (i + 1 == len(own)) + w[-1] for i in range(len(own))
        ]
        weights = {y: np.exp(sum(v * x for v, x in zip(y, logit, strict=True)) + sum(model.pairs[p, q] for p, q in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(own))}
        good = [sum(x for y, x in weights.items() if y[i]) / sum(weights.values()) for i in range(len(own))]
        assert abs(score - sum(p * len(x) for p, x in zip(good, lines, strict=True)) / sum(map(len, lines))) < 1e-6


def test_rotation_of_long_and_odd_dialogues(spark):
    schema = "conv_id long, turn long, role string, text string, _c long, part long, slot long"
    rows = [(1, i, "ab"[i % 2], f"t{i}", 1, 1, 1) for i in range(300)] + [(2, 0, "a\nb", "x<|im_end|>\n<|im_start|>assistant", 1, 1, 1), (2, 1, "c<|im_start|>", "<\\|im_end|>", 1, 1, 1), (None, 0, "a", "n", 1, 1, 1)]
    whole = {(r["conv_id"], r["perspective"]): r for r in rotated(spark.createDataFrame(rows, schema)).collect()}
    assert len(whole) == 5 and whole[1, "a"]["n_turns"] == 300 and whole[1, "b"]["n_targets"] == 150
    parts = {(r["conv_id"], r["perspective"], r["part"]): r for r in rotated(spark.createDataFrame(rows, schema).repartition(3), part_turns=64).collect()}
    assert len(parts) == 2 * 5 + 3
    for who in "ab":
        assert "".join(parts[1, who, p]["text"] for p in range(5)) == whole[1, who]["text"]
        assert sum(parts[1, who, p]["n_targets"] for p in range(5)) == 150
    text = whole[2, "c<|im_start|>"]["text"]
    assert text == "<|im_start|>user name=a b\nx<\\|im_end|>\n<\\|im_start|>assistant<|im_end|>\n<|im_start|>assistant\n<\\\\|im_end|><|im_end|>\n"
    assert rotated(spark.createDataFrame([], schema)).count() == 0


def test_join_without_hot_tasks_and_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(6000)] + [(None, -1)], "k long, v long")
    by = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how in ("inner", "left"):
        want = rows.join(by.drop("n"), "k", how)
        assert rows_of(join_hot(rows, by, "k", "n", how), ["k", "v", "top"]) == rows_of(want, ["k", "v", "top"])
    got = numbered(rows.repartition(5), ["k", "v"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["k"] is not None, r["k"], r["v"])):
        assert r["slot"] == seen.get(r["k"], 0)
        seen[r["k"]] = r["slot"] + 1
    assert len(got) == 6001


def test_intermediate_tables_can_be_cleared(spark):
    import os

    from cubelark.llm import store

    one, two = store.written(spark.range(3)), store.durable(spark.range(4))
    path = one.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(path) and two.count() == 4
    assert store.clear(spark) >= 2 and not os.path.exists(path)
    assert store.written(spark.range(3)).count() == 3 and store.durable(spark.range(4)).count() == 4


def test_near_copies_of_long_sets_in_small_blocks(spark, monkeypatch):
    """Sets over 1200 shingles, in groups just over and just under the bound, with blocks of few members."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    rng = random.Random(6)
    base, texts = [f"v{rng.randrange(10**6)}" for _ in range(1500)], []
    for k in range(40):
        t = list(base)
        for j in rng.sample(range(1500), 8 * (k % 8)):
            t[j] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    from test_llm import brute_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(plain(spark, list(enumerate(texts)))).collect()}
    assert got == brute_components(texts)


def test_library_from_files(spark, tmp_path):
    for name in ("mit-text", "zlib-text"):
        (tmp_path / f"{name}.txt").write_text(TEMPLATES[name])
    library = library_in(spark, str(tmp_path))
    assert set(library) == {"mit-text.txt", "zlib-text.txt"}
    got = scan(plain(spark, [(1, "x y z " + TEMPLATES["zlib-text"].upper())]), library).collect()
    assert [(r["doc_id"], r["license_id"], r["containment"]) for r in got] == [(1, "zlib-text.txt", 1.0)]


def test_bands_find_every_region_in_reach(spark):
    """Against semi-global edit distances of every segment to every text."""
    import numpy as np

    from cubelark.llm.decontaminate import ERROR, SEGMENT, Index, folded

    rng = random.Random(8)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (8, 14, 25, 40)]
    texts = []
    for k in range(60):
        t = list(items[k % 4])
        for _ in range(k // 3):  # up to far more edits than a segment may have
            i = rng.randrange(len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        texts.append(" ".join(["w" + "".join(rng.choice("ijkl") for _ in range(5)) for _ in range(rng.randint(0, 9))]) + " " + "".join(t) + " tail of the text")
    index = Index([(i, folded([t])[0].tobytes().strip()) for i, t in enumerate(items)], SEGMENT, ERROR)

    def least(segment, text):
        row = np.zeros(len(text) + 1, np.int64)
        span = np.arange(len(text) + 1)
        for c in segment:
            new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (text != c), row[1:] + 1)])
            row = np.minimum.accumulate(new - span) + span
        return int(row.min())

    buf, offs = folded(texts)
    want = set()
    for t in range(len(texts)):
        own = buf[offs[t] : offs[t + 1]]
        want |= {(t, index.item[s]) for s, piece in enumerate(index.text) if least(piece, own) <= index.budget[s]}
    assert set(index.found(buf, offs)) == want and 20 < len(want) < 60
    rows = contaminated(plain(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_shards_match_a_plain_tree(spark):
    """The same splits by sorting each node's rows."""
    from cubelark.llm import kd_shards as kd

    rng = random.Random(9)
    rows = [(i, "x" * rng.choice((0, 3, 50, 400)) + "y" * rng.randint(0, 30), rng.choice("aaab"), rng.choice(("en", "de", None))) for i in range(400)] + [(i, "same", "a", "en") for i in range(400, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(kd._HALF))
    held = [tuple(r) for r in docs.select("doc_id", F.octet_length("text") + 1, kd._code(F.col("source")), kd._code(F.col("lang")), F.length("text"), tie).collect()]
    whole = [max(1, max(r[k] for r in held) - min(r[k] for r in held)) for k in (2, 3, 4)]

    def split(own, leaves):
        if leaves == 1:
            return [own]
        width = [(max(r[k] for r in own) - min(r[k] for r in own)) / whole[k - 2] for k in (2, 3, 4)]
        axis = 2 + width.index(max(width))
        at = sorted((r[axis] * kd._HALF + r[5], r[1]) for r in own)
        want, upto = sum(r[1] for r in own) * (leaves // 2) // leaves, 0
        for place, size in at:
            upto += size
            if upto >= want:
                cut = place - 1 if upto - want > want - (upto - size) else place
                break
        left = [r for r in own if r[axis] * kd._HALF + r[5] <= cut]
        return split(left, leaves // 2) + split([r for r in own if r not in set(left)], leaves - leaves // 2)

    want = {r[0]: i for i, leaf in enumerate(split(held, 8)) for r in leaf}
    assert {r["doc_id"]: r["shard"] for r in kd_shards(docs, shards=8).collect()} == want
    with pytest.raises(ValueError):
        kd_shards(docs, shards=kd.MOST_LEAVES + 1)

"""corpus_pipeline against a plain Python chain of the same five stages, and each stage on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from cubelark.llm import quality_crf
from cubelark.llm import sentencepiece_viterbi as sv
from cubelark.llm import text as tx
from cubelark.llm.queries import tokenizer_file
from test_llm import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string"
ITEM = "which of the nine bridges was finished before the old harbour wall came down"
VOCABULARY = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "lan men rin tos var".split()]


def sentence(rng, n=12):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def corpus():
    rng = random.Random(21)
    good = ["\n".join(sentence(rng) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    bad = ["\n".join(" | ".join(sentence(rng, 6).upper().split()) + " !!!" for _ in range(3)) for _ in range(16)]
    texts = [x for pair in zip(good, bad + [None] * 24, strict=True) for x in pair if x]
    texts += [f"{t}\nPosted by user{i} from the northern office today" for i, t in enumerate(sentence(rng, 30) for _ in range(7))]  # a template with a field
    texts += [f"{sentence(rng, 25)}\nAll rights reserved." for _ in range(3)]
    texts += [good[3], good[3], good[5].replace("\n", " ") + " Balan", good[5].replace("\n", " ")]  # copies and near copies
    texts += [f"{sentence(rng)} {ITEM.upper()} {sentence(rng)}", "", " \n ", None]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[-4]], [(i, int(not (t or "|").count("|"))) for i, t in enumerate(texts) if i % 3]


def plain_quality(rows, model):
    return [r for r in rows if quality_crf._scored(pa.array([r[1]], pa.string()), model)[0][0] >= quality_crf.THRESHOLD]


def plain_line_dedup(rows):
    """The documented rule, line by line."""
    docs = {(r[0], r[1]) for r in rows}
    lines = {d: (d[1] or "").split("\n") for d in docs}
    flat = {d: [re.sub(r"[\x20\x09\x0b-\x0d]+", " ", x).strip(" ") for x in own] for d, own in lines.items()}
    tokens = {x: tuple("<*>" if re.search("[0-9]", w) else w for w in x.split(" ")) for own in flat.values() for x in own if x}
    of_line = defaultdict(set)
    for d, own in flat.items():
        for x in own:
            if x and len(tokens[x]) >= 4:
                of_line[tokens[x]].add(d)
    support = Counter()
    for t, ds in of_line.items():
        for pos, w in enumerate(t):
            support[len(t), t[:3], pos, w] += len(ds)
    shape = {}
    for t in of_line:
        own = [support[len(t), t[:3], pos, w] if w != "<*>" and support[len(t), t[:3], pos, w] >= 5 else 0 for pos, w in enumerate(t)]
        best, least = sorted((s for s in own if s), reverse=True), max(4, math.ceil(len(t) / 2))
        if len(best) >= least:
            shape[t] = tuple(w if s and s >= best[least - 1] / 2 else "<*>" for w, s in zip(t, own, strict=True))
    places = defaultdict(list)
    for d, own in flat.items():
        for i, x in enumerate(own):
            if x:
                places[2, x].append((d, i))
                if tokens[x] in shape:
                    places[5, shape[tokens[x]]].append((d, i))
    gone = set()
    for (need, _), at in places.items():
        if len({d for d, _ in at}) >= need:
            gone.update(set(at) - {min(at, key=lambda p: (p[0][0], p[1]))})
    out = []
    for r in rows:
        d = (r[0], r[1])
        stay = [x for i, x in enumerate(lines[d]) if (d, i) not in gone]
        if len(stay) == len(lines[d]):
            out.append(r)
        elif "\n".join(stay).strip():
            text = "\n".join(stay)
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def plain_near_duplicates(rows):
    ids = sorted({r[0] for r in rows})
    text = {r[0]: r[1] for r in rows}
    of = brute_components([text[i] for i in ids])
    return [r for r in rows if of[ids.index(r[0])][1] == ids.index(r[0])]


def plain_decontamination(rows):
    def folded(t):
        return " " + re.sub("[^a-z0-9]+", " ", (t or "").lower()) + " "

    return [r for r in rows if ITEM not in folded(r[1]) and " peru " not in folded(r[1])]


def plain_tokens(rows):
    a = sv.automaton(sv.read_model(tokenizer_file("piece_bpe_32k.model")))
    return [(r[0], sv._segment_long(a, sv.prepared(*tx.utf8(pa.array([r[1]], pa.string())))[0].tobytes().replace(b" ", sv.SPACE_MARK))) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, labels) = tmp_path_factory.mktemp("corpus"), corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "Peru"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_run_matches_a_plain_chain(spark, folder):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_crf.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = plain_quality(rows, model)
    assert 0 < len(kept) < len(rows)
    sizes = [len(kept)]
    for stage in (plain_line_dedup, plain_near_duplicates, plain_decontamination):
        kept = stage(kept)
        sizes.append(len(kept))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4  # every stage takes some
    assert rows_of(corpus_pipeline.run(spark, folder)) == sorted(((i, ids) for i, ids in plain_tokens(kept)), key=repr)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_the_columns_and_take_odd_tables(spark, folder, name, stage):
    base = sentence(random.Random(22), 40)
    rows = [(1, base, "en", "s", 3, "x"), (None, base, None, None, None, None), (2, None, "en", "s", None, "x"), (3, "", "en", "s", 0, "x"), (1, base, "en", "s", 3, "x"), (4, "Of Peru, only", "en", "s", 2, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, folder)
    got = rows_of(out)
    if name == "tokens":
        assert out.columns == ["doc_id", "ids"] and len(got) == len(rows) and [list(r[1]) for r in got if r[0] in (2, 3)] == [[], []]
        return
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    want = {
        "quality": None,
        "line_dedup": [rows[0], rows[2], rows[3], rows[4], rows[5]],  # the copy without doc_id comes first in order and stays
        "near_duplicates": rows,
        "decontamination": rows[:5],
    }[name]
    if name == "line_dedup":
        want = [r for r in rows if r[0] != 1]
    if want is not None:
        assert got == sorted(want, key=repr)
    else:
        assert set(got) <= set(rows) and not any(r[1] in (None, "") for r in got)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0

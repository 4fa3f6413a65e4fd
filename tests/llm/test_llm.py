"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubelark.llm import text as tx
from cubelark.llm.chat_rotation import rotated
from cubelark.llm.components import components
from cubelark.llm.decontaminate import SHORTEST, Index, banded, contaminated, decontaminate, folded
from cubelark.llm.exact_dedup import duplicate_groups, exact_dedup
from cubelark.llm.kd_shards import kd_shards
from cubelark.llm.license_scan import TEMPLATES, miss_probability, scan
from cubelark.llm.line_templates import drop_recurring_lines
from cubelark.llm.ngram_join import bands, jaccard_components, near_duplicate_filter
from cubelark.llm.quality_crf import Crf, classified, line_features, with_neighbours
from cubelark.llm.queries import tokenizer_file
from cubelark.llm.sentencepiece_viterbi import automaton, decode, decode_documents, encode, encode_documents, prepared, read_model
from cubelark.llm.simple8b import WordEncoder, block_sizes, encode_to_index, pack, read_tokens, unpack, write_tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOC + ", _doc string, n long, component string, line_no long, _maybe string, shard string"
WORDS = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, schema=DOC):
    more = schema.count(",") - 4
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), *["1" if "string" in p else 1 for p in schema.split(",")[5:]]) for i, t in enumerate(texts)]
    assert all(len(r) == 5 + more for r in rows)
    return spark.createDataFrame(rows, schema)


ODD = [None, "", " \n\t ", "one", "two words\n", "é ü 日本語 🎉", "x" * 3000, "A b c d e", "a  B\tc\nd e", "a b c d e f"]


def near_texts(seed=1):
    rng = random.Random(seed)
    out = list(ODD)
    for n in (5, 8, 30, 120, 700):
        base = words(rng, n).split()
        for k in range(7):
            t = list(base)
            for _ in range(k * max(1, n // 60)):
                t[rng.randrange(n)] = rng.choice(WORDS)
            out.append(" ".join(t))
    out += [words(rng, 60) for _ in range(20)] + [out[12]] * 4
    return out


def brute_components(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("schema", [DOC, EXTRA])
def test_ngram_join_matches_brute_force(spark, schema):
    texts = near_texts()
    df = frame(spark, texts, schema)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    want = brute_components(texts)
    assert got == want
    if schema == EXTRA:
        left = {r[0] for r in near_duplicate_filter(df).select("doc_id").collect()}
        assert left == {i for i, (_, c) in want.items() if i == c}


@pytest.mark.parametrize("block", [2048, 9])
def test_ngram_join_counts_every_link(spark, monkeypatch, block):
    from cubelark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(14)
    base = [words(rng, 300).split() for _ in range(2)]
    texts = list(ODD)
    for k in range(40):
        t = list(base[k % 2])
        for _ in range(k // 8):
            t[rng.randrange(300)] = f"own{k}"
        texts.append(" ".join(t))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").lower().split() for t in texts)]
    kinds = set(sets) - {frozenset()}
    want = {i: sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in kinds) if s else 0 for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["n_links"] for r in jaccard_components(frame(spark, texts)).collect()} == want
    assert max(want.values()) > 10


def test_ngram_join_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).count() == 0


def test_bands_cover_all_sizes_and_leave_room():
    table = bands(100_000)
    assert table[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(table, table[1:]))
    assert all(m > k and k == hi // 4 for _, hi, k, m in table)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("schema", [DOC, EXTRA])
def test_exact_dedup(spark, schema):
    texts = ODD + ["a \t b", "a b", "a  b", None, "solo"] * 3
    df = frame(spark, texts, schema)
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    first, count = {}, collections.Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in duplicate_groups(df).collect()}
    assert got == {i: (first[t], count[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    assert {r[0] for r in exact_dedup(df).select("doc_id").collect()} == set(first.values())
    assert duplicate_groups(frame(spark, [])).count() == 0


def test_line_templates_keep_the_first_and_generalise_fields(spark):
    rng = random.Random(2)
    own = [words(rng, 12).replace("w", "x") for _ in range(8)]
    logs = [f"user login from host {'abcdefgh'[i]} at node {i} ended well" for i in range(8)]
    texts = [f"{own[i]}\n{logs[i]}\nshort line" for i in range(8)] + ODD
    df = frame(spark, texts, EXTRA)
    got = {r["doc_id"]: r for r in drop_recurring_lines(df, shortest=4).collect()}
    assert got[0]["text"] == texts[0] and got[0]["_dropped"] == 0
    assert all(got[i]["text"] == f"{own[i]}\nshort line" and got[i]["_dropped"] == 1 for i in range(1, 8))
    assert all(got[8 + i]["text"] == t for i, t in enumerate(ODD))
    assert drop_recurring_lines(frame(spark, [])).count() == 0


def test_line_templates_find_fields_with_frequent_values(spark):
    rng = random.Random(12)
    names, cities = ([f"{kind}{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] for kind in ("n", "c"))
    for n in (40, 2000):
        texts = [f"Posted by user {rng.choice(names)} from {rng.choice(cities)} on our board" for _ in range(n)]
        texts += [f"Posted by user {names[i]} has seen the other {cities[i]} twice" for i in range(3)]  # same leaf, too few documents
        rows = {r["doc_id"]: r["_dropped"] for r in drop_recurring_lines(frame(spark, texts)).collect()}
        assert rows == {i: int(0 < i < n) for i in range(n + 3)}


def test_unchanged_lines_recur_in_two_documents_however_short(spark):
    rng = random.Random(13)
    own = [words(rng, 12) for _ in range(4)]
    texts = [f"{own[0]}\nAll rights reserved.\n\na line of several plain words", f"All  rights reserved.\n{own[1]}\n\na line of  several plain words", f"{own[2]}\nVersion 2 released", f"{own[3]}\nVersion 3 released\nonce\nonce"]
    got = {r["doc_id"]: (r["text"], r["_dropped"]) for r in drop_recurring_lines(frame(spark, texts, EXTRA)).collect()}
    assert got == {0: (texts[0], 0), 1: (f"{own[1]}\n", 2), 2: (texts[2], 0), 3: (texts[3], 0)}


def edit(text, rng, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i] = rng.choice("abcxyz")
    return "".join(t)


def test_decontamination_finds_edited_passages_only(spark):
    rng = random.Random(3)
    items = [words(rng, 30), words(rng, 60), words(rng, 12), "tiny", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = [words(rng, 80) for _ in range(10)]
    hit = [clean[0] + " " + items[0].upper() + " " + clean[1], clean[2] + "\n" + edit(items[1], rng, 6) + "\n", items[2], clean[3] + items[0].replace(" ", " - ") + clean[4], items[1][: len(items[1]) // 2]]
    df = frame(spark, clean + hit + ODD)
    rows = contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(10, 0), (11, 1), (12, 2), (13, 0), (14, 1)}
    assert {r[0] for r in decontaminate(df, bench).select("doc_id").collect()} == set(range(10)) | set(range(15, 15 + len(ODD)))
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_banded_alignment_is_an_edit_distance():
    rng = random.Random(4)

    def brute(a, b):  # of a to a part of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(5, 20)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(5, 30)))
        got = banded(a.encode(), b.encode(), len(a), len(a) + len(b))
        assert got is not None and got[0] == brute(a, b)
    assert len(Index([(0, b"x" * (SHORTEST - 1))], 96, 0.1).item) == 0 and len(Index([(0, b"x")], 96, 0.1).short) == 1
    assert folded(["A--b  É"])[0].tobytes().decode() == " a b é "


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    good = ["\n".join(words(rng, 12).capitalize() + "." for _ in range(4)) for _ in range(120)]
    bad = ["\n".join(" | ".join(words(rng, 12).upper().split()) for _ in range(4)) for _ in range(120)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + ODD
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in classified(df, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r["held_out"] and i < 240} == set(held)
    assert np.mean([rows[i]["predicted"] == 1 - i % 2 for i in held]) > 0.95
    assert all(r["score"] == 0.5 for r in classified(df, labels.limit(0)).where("n_lines > 0").collect())


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    model = Crf(np.zeros(1), rng.normal(size=(2, 2)))
    logits, at = rng.normal(size=7), np.array([0, 3, 3, 7])
    got, joint = model.marginals(logits, at)
    want, pairs = np.zeros(7), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 7)):
        weights = {}
        for code in range(1 << (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            weights[tuple(y)] = np.exp(sum(logits[a + k] * v for k, v in enumerate(y)) + sum(model.pairs[p, q] for p, q in zip(y, y[1:])))
        z = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for p, q in zip(y, y[1:]):
                pairs[p, q] += w / z
    assert np.allclose(got, want) and np.allclose(joint, pairs)


def test_neighbour_features_stop_at_text_ends():
    buf, offs = tx.utf8(pa.array(["a b\nc d", None, "e f"]))
    own, size, at = line_features(buf, offs)
    assert at.tolist() == [0, 2, 2, 3] and size.tolist() == [4.0, 3.0, 3.0]
    f, w = with_neighbours(own, at), own.shape[1]
    assert not f[0, w : 2 * w].any() and not f[2, w : 2 * w].any() and (f[0, 2 * w : 3 * w] == own[1]).all()


@pytest.fixture(scope="module")
def model():
    return read_model(tokenizer_file("piece_bpe_32k.model"))


def test_segmentation_matches_the_library_in_unigram_mode(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1 and p.score < -1e8:  # beyond what the library's 32-bit sums can tell apart
            p.score = -40000.0
    data = proto.SerializeToString()
    lib, a = sentencepiece.SentencePieceProcessor(model_proto=data), automaton(data)
    texts = [t or "" for t in ODD] + ["  a  b ", "▁ a▁b", "the quick brown fox's 12,5 €", "\n\n"]
    ids, at = encode(a, *prepared(*tx.utf8(pa.array(texts))))
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [lib.encode(t) for t in texts]
    back, offs = decode(a, ids, at)
    assert [back[i:j].tobytes().decode() for i, j in zip(offs[:-1], offs[1:])] == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_round_trip(spark, model):
    df = frame(spark, ODD + ["ab " * 400], EXTRA)
    encoded = encode_documents(df, model)
    assert {r["doc_id"]: r["text"] for r in decode_documents(encoded, model).collect()} == {i: t or "" for i, t in enumerate(ODD + ["ab " * 400])}
    assert encode_documents(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("top", [0, 1, 200, 60_000, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(top):
    sizes = block_sizes(np.array([0, 1, 127, 128, 129, 500, 0, 3]))
    values = np.random.default_rng(1).integers(0, top, int(sizes.sum()), dtype=np.uint64, endpoint=True)
    packed, offs = pack(values, sizes)
    assert (unpack(packed, offs, sizes) == values).all()


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    data = read_model(tokenizer_file("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b <|startoftext|>", "don't can't 'S", "Σς ΑΣ ΟΔΟΣ", "é ́a b", "x y"]
    ids, at = WordEncoder(data)(*tx.utf8(pa.array(texts)))
    want = [e.ids for e in Tokenizer.from_str(data.decode()).encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want


def test_token_file_index(spark, tmp_path):
    from tokenizers import Tokenizer

    data = read_model(tokenizer_file("word_bpe_49k.json"))
    df = frame(spark, ODD + ["the end"], EXTRA)
    want, start = {}, 0
    lib = Tokenizer.from_str(data.decode())
    for i, t in enumerate(ODD + ["the end"]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in encode_to_index(df, data).collect()}
    assert got == want
    write_tokens(df, data, str(tmp_path / "t"), 2)
    assert {r["doc_id"]: len(r["ids"]) for r in read_tokens(spark, str(tmp_path / "t")).collect()} == {i: w[1] for i, w in want.items()}
    assert encode_to_index(frame(spark, []), data).count() == 0


def test_kd_shards_balance_bytes(spark):
    rng = random.Random(7)
    texts = ODD + [words(rng, rng.randint(5, 60)) for _ in range(600)] + ["same text here"] * 300
    rows = kd_shards(frame(spark, texts, EXTRA), shards=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert kd_shards(frame(spark, []), shards=8).count() == 0
    assert kd_shards(frame(spark, ["a"] * 9), target_bytes=6).select("shard").distinct().count() == 3


def test_rotation_renders_each_speaker_as_assistant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "ho"), (1, 2, "bob", "ho"), (2, 0, "system", "x"), (3, None, None, None), (4, 300, "ann", "late"), (4, 0, "ann", "")]
    got = {(r["conv_id"], r["part"], r["perspective"]): r for r in rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "unknown"), (4, 0, "ann")}
    r = got[1, 0, "bob"]
    assert r["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n"
    begin, end = map(int, r["loss_spans"].split(":"))
    assert r["text"][begin:end] == "ho<|im_end|>" and r["n_targets"] == 1
    many = spark.range(700).select(F.lit(1).alias("conv_id"), F.lit(5).alias("turn"), F.lit("a").alias("role"), F.col("id").cast("string").alias("text"))
    assert rotated(many).agg(F.sum("n_turns")).first()[0] == 700
    assert rotated(many.limit(0)).count() == 0


def test_license_scan(spark):
    rng = random.Random(8)
    keys = sorted(TEMPLATES)
    texts = [f"{words(rng, 37)} {TEMPLATES[k].upper()} {words(rng, 53)}" for k in keys] + [words(rng, 200)] + ODD
    edited = TEMPLATES["mit-permission"].split()
    edited[-1] = "changed"
    rows = scan(frame(spark, texts + [" ".join(edited)], EXTRA)).collect()
    found = {(r["doc_id"], r["license_id"]) for r in rows}
    assert {(i, k) for i, k in enumerate(keys)} <= found and (len(texts), "mit-permission") in found
    assert all(i < len(keys) or i == len(texts) for i, _ in found)
    assert miss_probability() < 3e-5
    assert scan(frame(spark, [])).count() == 0 and scan(frame(spark, ["a b c d e f"]), {}).count() == 0


def test_license_scan_finds_short_templates(spark):
    rng = random.Random(18)
    library = TEMPLATES | {"two": "Zed licence", "one": "qqlicence", "none": " - "}
    texts = ["ALL rights, reserved", f"{words(rng, 9)} all rights reserved {words(rng, 70)} All rights reserved.", f"{words(rng, 50)} zed licence", "qqlicence", "all rights are reserved", "rights reserved all", "", None, TEMPLATES["mpl-2.0-notice"]]
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["start"]) for r in scan(frame(spark, texts, EXTRA), library).collect()}
    assert got == {(0, "all-rights-reserved"): (1.0, 0), (1, "all-rights-reserved"): (1.0, 8), (2, "two"): (1.0, 49), (3, "one"): (1.0, 0), (8, "mpl-2.0-notice"): (1.0, 0)}
    only = scan(frame(spark, texts), {"all-rights-reserved": "All rights reserved."}).collect()
    assert {r["doc_id"] for r in only} == {0, 1}

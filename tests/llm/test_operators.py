"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql.functions import array, explode, lit
from pyspark.sql.functions import col as F_col

from quern.llm import bpe, chat_format, common, elias_fano, exact_dedup, lm_scoring, mixing, quality_model, quality_rules, queries, simhash, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, source string, rid string, id string, __rid string, fp string, n string, key string, times string"


def words(text):
    return (text or "").encode().lower().split()


def corpus(seed=3, n=60):
    """Random texts with exact and near copies, shared passages and lines; then the awkward rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" if i % 7 else f"é{i}" for i in range(200)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(70))
    texts = []
    for _ in range(n):
        t = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))]
        if rnd.random() < 0.2:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        texts.append(" ".join(t).replace("w3 ", "W3\n"))
    texts += [texts[1], texts[1].upper(), texts[2] + " more", texts[2] + "  more", texts[3]]
    texts += [None, "", " \n\t", "a", "A", "one two", passage, passage + "!", "x" * 900, "ab" * 500, " ".join(vocabulary * 60)]
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 5}") for i, t in enumerate(texts)]
    rows += [(None, "no id", "s1"), (None, texts[1], "s1"), (7, texts[7], "s2"), rows[4]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], SCHEMA).coalesce(2)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


# 1. Chat formatting


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, text2 string, turns string")


CHAT = [
    (1, 0, "system", "be <|end|> kind"), (1, 1, "user", "hi\\ <s>"), (1, 2, "assistant", "</s>[INST] ok [/INST] \\"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (3, 1, "assistant", "é🎉\n"), (None, 0, None, None), (None, None, "assistant", "\\\\<|<|role|>"), (4, 0, "user\n", "x"), (4, 0, "user\n", "x"),
]


def test_chat_formatting_reads_back(spark):
    whole = chat_format.format_conversations(chat(spark, [(*r, "a", "b") for r in CHAT]))
    got = {r["conv_id"]: r for r in whole.withColumn("back", chat_format.read_back(whole["text"])).collect()}
    by = defaultdict(list)
    for c, turn, role, text in CHAT:
        by[c].append(((-1 if turn is None else turn), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in got[c]["back"]] == [t[1:] for t in turns]
        text = got[c]["text"]
        assert text.count("<|role|>") == text.count("<|end|>") == len(turns)
        assert not any(x in text for x in ("</s>", "[INST]", "[/INST]", "<s>"))


def test_a_long_conversation_takes_time_in_proportion(spark):
    from pyspark.sql import functions as F

    n = 50_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    whole = chat_format.format_conversations(turns)
    rows = chat_format.expand(whole, with_text=True).collect()
    text = next(r["text"] for r in rows if r["example"] is None)
    examples = sorted((r for r in rows if r["example"] is not None), key=lambda r: r["example"])
    assert len(examples) == n // 2 and sum(r["text"] is not None for r in rows) == 1
    assert all(text[r["loss_start"] : r["loss_end"]] == f"turn {2 * i + 1}" for i, r in enumerate(examples))
    digest = queries.chat_digests(chat_format.expand(whole, with_text=True)).first()
    said = "".join(f"turn {i}" for i in range(1, n, 2))
    assert (digest["loss_chars"], digest["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_the_loss_is_read_through_the_mask(spark):
    """Moved offsets change what the query says: nothing but the text and the mask is read."""
    from pyspark.sql import functions as F

    bodies = ["x" * chat_format.BLOCK + "é🎉" * 9_000 + "y", "", "ok </s>", "z" * (2 * chat_format.BLOCK)]
    rows = [(1, i, "assistant", b, "a", "b") for i, b in enumerate(bodies)]
    examples = chat_format.expand(chat_format.format_conversations(chat(spark, rows)), with_text=True)
    right = queries.chat_digests(examples).first()
    said = "".join(bodies)
    assert (right["loss_chars"], right["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for column in ("loss_start", "loss_end"):
        moved = examples.withColumn(column, F.when(F.col("example") == 2, F.col(column) + 1).otherwise(F.col(column)))
        assert queries.chat_digests(moved).first()["loss_sha256"] != right["loss_sha256"]


def test_a_very_long_text_is_formatted_whole(spark):
    body = "é[INST] </s> \\ " * 100_000
    row = chat_format.format_conversations(chat(spark, [(1, 0, "assistant", body, "a", "b")])).first()
    (span,) = row["spans"]
    assert chat_format.CONTROL[4] not in row["text"] and row["text"][span["start"] : span["end"]].replace("\\[", "[").count("é") == 100_000
    assert chat_format.format_conversations(chat(spark, [(1, 0, "assistant", body, "a", "b")])).select(chat_format.read_back(F_col("text")).alias("t")).first()["t"][0]["text"] == body


def test_prefix_targets_have_only_their_reply_trainable(spark):
    whole = chat_format.format_conversations(chat(spark, [(*r, "a", "b") for r in CHAT]))
    texts = {r["conv_id"]: r["text"] for r in whole.collect()}
    for r in chat_format.materialise(whole).collect():
        text = texts[r["conv_id"]]
        assert r["text"] == text[: r["loss_end"] + len("<|end|>")] and r["reply"] == text[r["loss_start"] : r["loss_end"]] and r["context"] == text[: r["loss_start"]]
        assert r["context"].endswith("<|role|>assistant<|text|>")
    counts = Counter(r["conv_id"] for r in chat_format.expand(whole).collect())
    assert counts == {1: 2, 3: 2, None: 1}
    assert chat_format.format_conversations(chat(spark, [])).count() == 0


# 2. Mixing


def brute_mix(rows):
    size = [len(words(t)) for _, t, _ in rows]
    keys = sorted({"z" if s is None else "a" + s for *_, s in rows})
    weight = {k: (3.0, 1.0, 2.0)[i % 3] for i, k in enumerate(keys)}
    of = ["z" if s is None else "a" + s for *_, s in rows]
    total = {k: sum(n for n, o in zip(size, of) if o == k) for k in keys}
    budget, target, open_ = 1.5 * sum(size), {}, set(keys)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 2.0 * total[k]}
        if not full:
            target |= {k: level * weight[k] for k in open_}
            break
        target |= {k: 2.0 * total[k] for k in full}
        open_ -= full
    entries = []
    for k in keys:
        queue = sorted((hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}/mix".encode()).hexdigest(), -1 if rows[i][0] is None else rows[i][0], size[i], i) for i in range(len(rows)) if of[i] == k)
        upto = 0
        for p in range(2):
            for key, d, n, i in queue:
                upto += n
                entries.append((upto / target[k] if target[k] else 0.0, k, p, key, d, n, i))
    times, run = Counter(), 0
    for *_, n, i in sorted(entries):
        run += n
        if run > budget:
            break
        times[i] += 1
    return size, total, target, of, times


def test_mixing_matches_brute_force(docs, rows):
    size, total, target, of, times = brute_mix(rows)
    got = mixing.mix(docs).collect()
    expected = Counter((rows[i][0], size[i], total[of[i]], round(target[of[i]], 6), times[i] * size[i]) for i in range(len(rows)))
    assert Counter((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == expected
    assert sum(r["taken"] for r in got) <= 1.5 * sum(size) and all(r["times"] <= 2 for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r["id"], r["size"], r["taken"]) for r in again) == Counter((r["id"], r["size"], r["taken"]) for r in got)


def test_mixing_is_the_same_in_any_parts(docs, spark):
    whole, parts = (sorted(map(tuple, mixing.mix(docs, rows_per_part=n).drop("rid").collect()), key=str) for n in (5_000, 2))
    assert whole == parts


def test_mixed_repeats_rows_and_keeps_columns(docs, spark):
    plan = mixing.mix(docs).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in plan)
    assert mixing.mix(empty(spark)).count() == 0


# 3. SimHash


def brute_fingerprint(text, width):
    w = words(text)
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits):
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_matches_brute_force(docs, rows, crowd):
    prints = [brute_fingerprint(t, 3) for _, t, _ in rows]
    root = components(prints, 2)
    least = {}
    for (d, _, _), p in zip(rows, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    got = simhash.near_duplicates(docs, 3, 2, crowd=crowd)
    same(((r["id"], r["h"], r["component_id"]) for r in got.withColumn("h", simhash.fingerprint_hex(got["fp"])).collect()), [(d, f"{p:016x}", least.get(root[p])) for (d, _, _), p in zip(rows, prints)])


@pytest.mark.parametrize("bits,crowd", [(2, 64), (2, 2), (1, 64), (3, 64)])
def test_links_find_all_components(spark, bits, crowd):
    rnd = random.Random(bits)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1, 1 << 63, *centres}
    for c in centres[:6]:  # chains and dense clusters
        x = c
        for _ in range(25):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, bits + 2)))
            prints.add(x)
        prints |= {c ^ (1 << b) for b in rnd.sample(range(64), 12)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), bits, crowd)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    expected = components(list(prints), bits)
    groups = lambda m: sorted(sorted(g) for g in _invert(m).values())
    assert groups({p: found.get(s, s) for p, s in signed.items()}) == groups(expected)


def _invert(m):
    out = defaultdict(list)
    for k, v in m.items():
        out[v].append(k)
    return out


def test_one_of_each_near_group_stays(docs, spark):
    info = simhash.similar_documents(docs).collect()
    out = simhash.without_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len({r["root"] for r in info})
    assert simhash.near_duplicates(empty(spark)).count() == simhash.similar_documents(empty(spark)).count() == 0


def test_long_fingerprints_keep_the_majority_of_each_word():
    text = "a b c d e f g h A b c d e"
    hashes = np.concatenate(list(simhash.shingle_hashes(text, 5)))
    first = np.frombuffer(simhash.long_fingerprint(text, 5), "<u8")
    assert len(first) == simhash.WORDS and int(first[0]) == brute_fingerprint(text, 5) and len(set(first.tolist())) == simhash.WORDS
    assert len(hashes) == 9 and simhash.long_fingerprint(None, 5) == simhash.long_fingerprint(" ", 5) == bytes(simhash.RING)


@pytest.mark.parametrize("crowd,rows", [(64, 20_000), (3, 20_000), (3, 4)])
def test_similar_links_find_planted_groups(spark, crowd, rows, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    rnd = random.Random(crowd)
    prints, group = [], {}
    for g in range(40):
        centre = rnd.getrandbits(256)
        for k in range(rnd.choice([1, 2, 30])):
            x = centre ^ sum(1 << b for b in rnd.sample(range(256), 10 if k else 0))
            group[len(prints)] = g
            prints.append((len(prints), bytearray(x.to_bytes(32, "little"))))
    links = simhash.similar_links(spark.createDataFrame(prints, "node long, fp binary"), 44, crowd)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert _partition({n: found.get(n, n) for n in group}) == _partition(group)


def one_bucket(pairs):
    """Pairs of fingerprints with 16 bits of difference that agree in no neighbouring bytes but the first two."""
    rnd = random.Random(5)
    out = []
    for k in range(pairs):
        x = bytearray(b"ab" + rnd.randbytes(30))
        y = bytearray(b ^ (i > 1 and i % 2 == 0 or i == 31) for i, b in enumerate(x))
        out += [(2 * k, x), (2 * k + 1, y)]
    return out


def test_similar_links_have_one_rule_at_every_size(spark, monkeypatch):
    prints = spark.createDataFrame(one_bucket(1), "node long, fp binary")
    monkeypatch.setattr(type(prints), "count", lambda self: 3_000_000)
    assert [tuple(r) for r in simhash.similar_links(prints, 44).collect()] == [(0, 1)]


def test_similar_links_pass_over_no_pair_of_a_full_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    links = simhash.similar_links(spark.createDataFrame(one_bucket(30), "node long, fp binary"), 44)
    assert sorted(tuple(sorted(r)) for r in links.collect()) == [(2 * k, 2 * k + 1) for k in range(30)]


@pytest.mark.parametrize("holders", [2000, 4])
def test_similar_documents_are_those_of_exact_jaccard(spark, holders, monkeypatch):
    """Copies with scattered edits, from well above to well below the limit, round it above all; two share a passage."""
    monkeypatch.setattr(simhash, "HOLDERS", holders)
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    passage, texts = [word() for _ in range(60)], []
    for g in range(40):
        text = [word() for _ in range(rnd.randrange(60, 400))] + passage
        texts.append(text)
        for _ in range(3):
            copy = list(text)
            for at in rnd.sample(range(len(copy) - 60), max(1, round(len(copy) * rnd.uniform(0.012, 0.04)))):
                copy[at] = word()
            texts.append(copy)
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root, near = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if 5 * both >= 4 * (len(grams[i]) + len(grams[j]) - both):
                near += 1
                root = [root[j] if r == root[i] else r for r in root]
    assert near > 40 and len(set(root)) > 50
    got = simhash.similar_documents(frame(spark, [(i, " ".join(t), "s") for i, t in enumerate(texts)])).collect()
    assert _partition({r["id"]: r["root"] for r in got}) == _partition(dict(enumerate(root)))


def _partition(m):
    return sorted(sorted(g) for g in _invert(m).values())


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest_has_all_components(seed):
    rnd = random.Random(seed)
    prints = [rnd.getrandbits(256) for _ in range(5)]
    prints += [rnd.choice(prints) ^ sum(1 << b for b in rnd.sample(range(256), rnd.randrange(8, 40))) for _ in range(60)]
    x = np.array([list(p.to_bytes(32, "little")) for p in prints], np.uint8)
    root = list(range(len(prints)))
    for i, j in simhash._tree(x, 30):
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    expected = components(prints, 30)
    assert _partition(dict(enumerate(root))) == _partition({i: expected[p] for i, p in enumerate(prints)})


# 4 and 6. Tokenizers

ALPHABET = st.lists(st.sampled_from([*"abcdeé'stre ll\n\t  ▁THE of 0123 ΣσİḰ\x1c\x85 　中文🎉ﬁ!!$$#\x00ß<|>", "<|endoftext|>", "<|startoftext|>", "</s>", "  ", "'ll", "ᾼ"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_bpe_matches_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe.DEFAULT)
    library = _once(("t", path), lambda: Tokenizer.from_file(path))
    ids = library.encode(text, add_special_tokens=False).ids
    mine = bpe.load(path).encode(text)
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert bpe.load(path).decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_words_are_merged_once(monkeypatch):
    """As many different words as some 30 MB of the fixture's text hold are kept, so none is merged again."""
    merged = []
    own = bpe.SegmentTreeBPE(bpe._path(None))
    monkeypatch.setattr(own, "merge", lambda symbols: merged.append(1) or symbols)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(300_000)]
    assert own.encode(" ".join(words)) == own.encode(" ".join(words))
    assert len(merged) == len(words)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_token_counts_match_the_library(text):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(token_counts.DEFAULT)
    library = _once(("s", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))
    assert token_counts.load(path).count(text) == len(library.encode(text))


_made = {}


def _once(key, make):
    if key not in _made:
        _made[key] = make()
    return _made[key]


def test_tokenizer_operators_keep_every_row(docs, rows, spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT))
    expected = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.encode_decode(docs).select("id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), expected)
    for r in bpe.encoded(docs).collect():
        assert library.decode(r["ids"], skip_special_tokens=False) == r["decoded"] and len(r["ids"]) == r["n_tokens"]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.DEFAULT))
    same(token_counts.token_counts(docs, limit=50).select("id", "n_bytes", "n_tokens", "over_limit").collect(), [(d, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 50) for d, t, _ in rows])
    assert bpe.encode(empty(spark)).count() == token_counts.token_counts(empty(spark)).count() == 0


# 5. Quality model


def test_quality_model_learns_held_out_labels(spark):
    rnd = random.Random(5)
    data, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.6
        t = " ".join(rnd.choice(["the", "plain", "word", "river", "of", "stone"]) + str(rnd.randrange(9)) * (rnd.random() < 0.1) for _ in range(rnd.randrange(20, 80)))
        data.append((i, t if good else t.upper().replace(" ", "!! "), "s"))
        labels.append((i, int(good)))
    data += [(None, None, None), (1000, "", "s"), (1001, "word", "s")]
    docs, marks = frame(spark, data), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    model = quality_model.train(docs, marks)
    got = quality_model.score(docs, model)
    assert got.count() == len(data)
    scores = {r["id"]: r["score"] for r in got.collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.3) == labels[i][1] for i in held]) > 0.95


def test_quality_model_ignores_held_out_labels(spark):
    docs = frame(spark, [(i, f"some words {i} here " * (1 + i % 7), "s") for i in range(60)])
    marks = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(60)], "doc_id long, quality int")
    a, b = (quality_model.train(docs, marks(f)) for f in (False, True))
    x = np.random.default_rng(0).random((50, len(quality_model.FEATURES)))
    assert (a.score(x) == b.score(x)).all()


def test_quality_model_takes_one_row_of_an_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality_model, "fit", lambda x, y: sizes.append(len(x)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    data = [(i, f"text {i}", "s") for i in range(50)] + [(i, f"again {k}", "s") for i in range(50) for k in range(10)]
    quality_model.train(frame(spark, data), labels, max_train=20)
    assert sizes == [20]


def test_quality_model_without_labels(spark):
    docs = frame(spark, [(1, "a b", "s")])
    model = quality_model.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_model.score(docs, model).collect()] == [0.5]
    assert quality_model.score(empty(spark), model).count() == 0


def brute_tree(g, w, leaves):
    parts = [(0, len(g))]
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(w[a:b]) + 1)
    while len(parts) < leaves:
        options = [(value(a, c) + value(c, b) - value(a, b), k, c) for k, (a, b) in enumerate(parts) for c in range(a + 1, b) if min(sum(w[a:c]), sum(w[c:b])) >= 0.05]
        best = max(options, key=lambda o: (o[0], -o[1], -o[2]), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(w[a:b]) + 1)] * (b - a)
    return out


def test_boosted_tables_are_those_of_plain_loops(monkeypatch):
    """Cyclic boosting with loops over rows, bins and cuts gives the same tables, and adding bins up the same scores."""
    monkeypatch.setattr(quality_model, "ROUNDS", 6)
    monkeypatch.setattr(quality_model, "PAIR_ROUNDS", 0)
    rnd = np.random.default_rng(3)
    x, y = rnd.random((80, 4)), (rnd.random(80) < 0.4).astype(float)
    y[x[:, 1] > 0.6] = 1.0
    model = quality_model.fit(x, y)
    total, tables = [model.bias] * len(y), [[0.0] * (len(e) + 1) for e in model.edges]
    bins = [[sum(v >= e for e in edges) for v in x[:, j]] for j, edges in enumerate(model.edges)]
    for _ in range(6):
        for j, table in enumerate(tables):
            g, w = [0.0] * len(table), [0.0] * len(table)
            for b, t, label in zip(bins[j], total, y):
                q = 1 / (1 + math.exp(-t))
                g[b] += label - q
                w[b] += q * (1 - q)
            step = [quality_model.RATE * v for v in brute_tree(g, w, 3)]
            tables[j] = [a + b for a, b in zip(table, step)]
            total = [t + step[b] for t, b in zip(total, bins[j])]
    for mine, plain in zip(model.tables, tables):
        assert mine == pytest.approx(plain, abs=1e-9)
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in total], abs=1e-9)


def test_pairs_and_their_tables_are_those_of_plain_loops(monkeypatch):
    """Which pairs are chosen, and the tables of trees of depth two over them, by loops over rows, cells and cuts."""
    monkeypatch.setattr(quality_model, "ROUNDS", 2)
    monkeypatch.setattr(quality_model, "PAIR_ROUNDS", 5)
    monkeypatch.setattr(quality_model, "PAIRS", 3)
    rnd = np.random.default_rng(8)
    x = rnd.random((150, 5))
    x[:, 4] = 0.5  # a feature of one value has one bin
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.6)).astype(float)
    y[:20] = 1 - y[:20]
    model = quality_model.fit(x, y)
    place = lambda edges, j: [sum(v >= e for e in edges) for v in x[:, j]]
    single = [place(e, j) for j, e in enumerate(model.edges)]
    coarse = [place(e, j) for j, e in enumerate(model.pair_edges)]
    total = [model.bias + sum(t[single[j][i]] for j, t in enumerate(model.tables)) for i in range(len(y))]

    def cells(a, b):
        g, w = ([[0.0] * (len(model.pair_edges[b]) + 1) for _ in range(len(model.pair_edges[a]) + 1)] for _ in range(2))
        for i, t in enumerate(total):
            q = 1 / (1 + math.exp(-t))
            g[coarse[a][i]][coarse[b][i]] += y[i] - q
            w[coarse[a][i]][coarse[b][i]] += q * (1 - q)
        return g, w

    def gain(a, b):
        g, w = cells(a, b)
        return sum(u**2 / (v + 1) for gs, ws in zip(g, w) for u, v in zip(gs, ws))

    pairs = sorted(((a, b) for b in range(5) for a in range(b)), key=lambda p: -gain(*p))[:3]
    assert model.pairs == pairs and pairs[0] == (0, 2)
    tables = [[[0.0] * (len(model.pair_edges[b]) + 1) for _ in range(len(model.pair_edges[a]) + 1)] for a, b in pairs]
    for _ in range(5):
        for k, (a, b) in enumerate(pairs):
            g, w = cells(a, b)
            halves = brute_tree([sum(r) for r in g], [sum(r) for r in w], 2)
            sides = [brute_tree([sum(c) for c in zip(*(g[i] for i in own))], [sum(c) for c in zip(*(w[i] for i in own))], 2)
                     for value in dict.fromkeys(halves) for own in [[i for i, h in enumerate(halves) if h == value]]]
            of = {value: side for value, side in zip(dict.fromkeys(halves), sides)}
            step = [[quality_model.RATE * v for v in of[h]] for h in halves]
            tables[k] = [[u + v for u, v in zip(us, vs)] for us, vs in zip(tables[k], step)]
            total = [t + step[i][j] for t, i, j in zip(total, coarse[a], coarse[b])]
    for mine, plain in zip(model.pair_tables, tables):
        assert np.allclose(mine, plain, atol=1e-9) and np.abs(mine).max() > 0
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in total], abs=1e-9)


def test_quality_model_on_the_fixture(spark):
    """Held-out accuracy on labels.quality, as the share of pairs of a good and a bad document in the right order."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["id"]: r["score"] for r in quality_model.score(docs, quality_model.train(docs, labels)).collect()}
    held = [(scores[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["quality"] is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95


def test_pair_tables_catch_what_single_features_cannot():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


# 7. Quality rules


def brute_measure(text):
    w = (text or "").encode().split()
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(windows)
    covered = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark, rows):
    more = [(100, "a b c d e f " * 5, "s"), (101, "x\nx\ny\n \n\nx\n", "s"), (102, "## $$ a|b <c>", "s"), (103, "p q r s t p q r s t u", "s"), (104, "HI!! " * 30, "s"), (105, "k v " * 3 + "k", "s")]
    data = rows + more
    book = quality_rules.ledger(frame(spark, data))
    got = book.collect()
    same([tuple(r[m] for m in ("id", *quality_rules.MEASURES[:5])) for r in got], [(d, *brute_measure(t)) for d, t, _ in data])
    for r in got:
        assert bool(r["failed"] & 1) == (r["n_words"] < 10) and bool(r["failed"] & 2) == (100 * r["n_repeat_words"] > 20 * r["n_words"])
    policy = quality_rules.POLICIES[1]
    kept = sum(1 for r in got if not r["failed"] & policy.mask)
    assert quality_rules.passing(frame(spark, data), policy).count() == kept
    for a in quality_rules.ablation(book, policy).collect():
        bit = 1 << list(quality_rules.RULES).index(a["rule"])
        assert a["n_failed"] == sum(bool(r["failed"] & bit) for r in got) and a["n_only"] == sum(r["failed"] == bit for r in got) and a["n_kept_without"] == sum(not r["failed"] & ~bit for r in got)
    assert quality_rules.passing(frame(spark, data)).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert quality_rules.ledger(empty(spark)).count() == 0


# 8. LM scoring


def brute_scores(rows):
    texts = [(d, [*words(t), None]) for d, t, _ in rows]
    out = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    c, pairs = Counter(), Counter()
    for (_, w), held in zip(texts, out):
        if not held:
            c.update(w)
            pairs.update(zip([0, *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    total, kinds = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[a] += 1
    for (d, w), held in zip(texts, out):
        base = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        p = [(max(pairs[a, x] - 0.75, 0) + 0.75 * kinds[a] * 10**b) / total[a] if total[a] else 10**b for a, x, b in zip([0, *w[:-1]], w, base)]
        yield d, held, len(w), sum(c[x] > 0 for x in w), n, sum(base), sum(map(math.log10, p))


@pytest.mark.parametrize("hot", [None, 5])
def test_lm_scores_match_brute_force(spark, docs, rows, hot, monkeypatch):
    if hot:  # spread contexts with many successors over shards
        monkeypatch.setattr(lm_scoring, "HOT_SUCCESSORS", hot)
        monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 200)
    expected = sorted(brute_scores(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    got = sorted(lm_scoring.lm_scores(docs).collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["n_tokens"]))
    assert [(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [e[:5] for e in expected]
    for r, e in zip(got, expected):
        assert r["base_score"] == pytest.approx(e[5], rel=1e-9) and r["score"] == pytest.approx(e[6], abs=0.025 * e[2])


def test_lm_without_training_rows(spark):
    got = lm_scoring.lm_scores(frame(spark, [(None, "a b", "s")])).collect()
    assert len(got) == 1 and got[0]["train_tokens"] == 0 and got[0]["score"] == 0.0
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=80), st.integers(0, 63))
def test_elias_fano_finds_all_and_nothing_else(values, shift):
    own = np.unique(np.array(values, np.uint64) >> np.uint64(shift))
    coded = elias_fano.EliasFano(own)
    assert (coded.get(np.arange(len(own))) == own).all()
    asked = np.concatenate((own, own + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
    place = {x: i for i, x in enumerate(own.tolist())}
    assert coded.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.lists(st.integers(0, 30), max_size=6), max_size=12))
def test_trie_looks_successors_up_in_their_contexts_range(grams):
    contexts = sorted(grams)
    successors = [sorted(set(grams[c])) for c in contexts]
    keys = np.array([i << elias_fano.Trie.SUCCESSOR | x for i, own in enumerate(successors) for x in own], np.uint64)
    trie = elias_fano.Trie(np.array(contexts, np.uint64), keys, np.full(len(keys), 0.25))
    at = trie.context(np.array([*contexts, 99], np.uint64))
    assert at.tolist() == [*range(len(contexts)), -1]
    first, end = trie.range(at)
    assert (end - first).tolist() == [*map(len, successors), 0]
    codes = trie.lookup(at, np.full(len(at), 31), np.tile(np.arange(31, dtype=np.uint64), len(at)))
    assert (codes.reshape(-1, 31) > 0).tolist() == [[x in own for x in range(31)] for own in [*successors, []]]


# 9. Suffix dedup


def brute_removed(rows, length, keep_first):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = defaultdict(list)
    for k, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((k, i))
    hit = [bytearray(len(b)) for b in data]
    for places in seen.values():
        for k, i in (places[1:] if keep_first else places) if len(places) > 1 else []:
            hit[k][i : i + length] = b"\1" * length
    for (d, _, _), b, h in zip(rows, data, hit):
        kept = bytes(x for x, m in zip(b, h) if not m)
        yield d, len(b), sum(h), sum(1 for i, m in enumerate(h) if m and (not i or not h[i - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,keep_first", [(200, False), (60, False), (60, True)])
def test_repeated_passages_match_brute_force(docs, rows, length, keep_first):
    got = suffix_dedup.repeated_passages(docs, length, keep_first)
    ordered = [rows[i] for i in range(len(rows))]
    same(got.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), list(brute_removed(ordered, length, keep_first)))


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    data = [(i, f"{'prefix %d ' % i * (i % 4)}" + "the same passage stands here again and again " * 3 + f"{i} end", "s") for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    got = suffix_dedup.repeated_passages(frame(spark, data), 60, False)
    same(got.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), list(brute_removed(data, 60, False)))
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0


def test_blocks_of_a_text_share_no_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 256)
    monkeypatch.setattr(suffix_dedup, "_tables", [])
    data = random.Random(9).randbytes(5000)
    for n in (59, 60, 255, 256, 257, 453, 5000):
        _, first, count, _, times = suffix_dedup.anchors(data[:n], 60)
        seen = [f + k for f, c, t in zip(first.tolist(), count.tolist(), times.tolist()) for k in range(c * t)]
        assert seen == list(range(max(0, n - 59)))


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("crowd", [3, 1000])
def test_runs_of_a_sign_take_few_rows(spark, keep_first, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "REPEATS", 100)
    assert len(suffix_dedup.anchors(b" " * 5000, 60)[0]) == 50
    texts = ["x" * 700, "start" + "x" * 130 + "end", "ab" * 300, "cab" * 100 + "x" * 64, "abc" * 90 + "q", " " * 59, " " * 60, " " * 61]
    data = [(i, t, "s") for i, t in enumerate(texts)]
    got = suffix_dedup.repeated_passages(frame(spark, data), 60, keep_first)
    same(got.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), list(brute_removed(data, 60, keep_first)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"aaab", b"aab", b"b", b"a", b"abab"]), min_size=1, max_size=40), st.integers(1, 6))
def test_longest_previous_factors_are_those_of_brute_force(parts, depth):
    data = b"".join(parts)
    n = len(data) - depth + 1
    if n < 1:
        return
    windows = np.array([np.frombuffer(data[i : i + depth], np.uint8) for i in range(n)])
    order = np.array(sorted(range(n), key=lambda i: (data[i : i + depth], hash((i, depth)))))
    shared = suffix_dedup.common_prefixes(windows[order])
    factors, sources = suffix_dedup.longest_previous_factors(order, shared, np.arange(n), depth)
    later = [data[i : i + depth] in {data[j : j + depth] for j in range(i)} for i in range(n)]
    assert (factors >= depth).tolist() == later
    count = Counter(data[i : i + depth] for i in range(n))
    assert ((factors >= depth) | sources).tolist() == [count[data[i : i + depth]] > 1 for i in range(n)]


@pytest.mark.parametrize("keep_first", [True, False])
def test_long_texts_lose_only_what_is_repeated(spark, keep_first):
    rnd = random.Random(9)
    text = rnd.randbytes((3 << 20) // 2 + 1000).hex()  # three blocks
    border = suffix_dedup.SPAN - 100
    data = [(0, text, "s"), (1, rnd.randbytes(500).hex() + text[border : border + 300] + rnd.randbytes(500).hex(), "s")]
    got = suffix_dedup.repeated_passages(frame(spark, data), 200, keep_first).orderBy("id").collect()
    assert [(r["n_removed"], r["n_spans"]) for r in got] == [(0, 0) if keep_first else (300, 1), (300, 1)]
    kept = text if keep_first else text[:border] + text[border + 300 :]
    assert got[0]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


# 10. Exact dedup


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=5))
def test_fingerprints_compose(data, cuts):
    parts = [data[a:b] for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(data)])]
    total = (0, 0, 0)
    for p in parts:
        total = exact_dedup.combine(total, exact_dedup.fingerprint(p))
    assert total == exact_dedup.fingerprint(data)


def test_long_fingerprints_and_comparison():
    data = random.Random(1).randbytes(3 * exact_dedup.PART_BYTES + 17)
    other = data[:-1] + bytes([data[-1] ^ 1])
    assert exact_dedup.fingerprint(data) == exact_dedup.combine(exact_dedup.fingerprint(data[:70000]), exact_dedup.fingerprint(data[70000:]))
    assert exact_dedup.same(data, bytes(data)) and not exact_dedup.same(data, other) and exact_dedup.fingerprint(data) != exact_dedup.fingerprint(other)


@pytest.mark.parametrize("salt", [2000, 2])
def test_exact_dedup_matches_brute_force(docs, rows, spark, salt):
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[norm(t)].append(d)
    got = exact_dedup.exact_duplicates(docs, rows_per_salt=salt).collect()
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    same([(r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], [(d, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for d, t, _ in rows])
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(k).hexdigest() for k in groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])
    out = exact_dedup.without_exact_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_huge_texts_are_hashed_in_parts(docs, spark):
    key = lambda r: (r["id"] is None, r["id"] or 0, r["text_sha256"], r["kept"])
    whole, parts = (sorted((tuple(r)[1:] for r in exact_dedup.exact_duplicates(docs, huge_chars=h, part_chars=7, rows_per_salt=3).collect()), key=str) for h in (1 << 25, 20))
    assert whole == parts


# Rows and frames


@pytest.fixture
def split_table(spark, tmp_path):
    data = [(i % 40, f"Text {i % 25} " * 30, None, "a", "b", "c", "d", "e", "f", "g") for i in range(200)]
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(str(tmp_path / "t.parquet"))
    yield str(tmp_path / "t.parquet")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def test_rows_keep_their_numbers_however_files_are_split(spark, split_table):
    seen = []
    for size in (1 << 27, 500):
        split(spark, size)
        rows = common.with_rid(common.stable(spark.read.parquet(split_table).filter("doc_id > 2")))
        seen.append((rows.rdd.getNumPartitions(), sorted((r["rid"], r["id"], r["text"]) for r in rows.collect())))
    assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1] and len({r[0] for r in seen[0][1]}) == len(seen[0][1])


def test_duplicates_are_found_if_splits_change_between_scans(spark, split_table, monkeypatch):
    real, sizes = exact_dedup.cut, iter([500, 1 << 27] * 20)

    def cut(df):
        out = real(df)
        split(spark, next(sizes))
        return out

    monkeypatch.setattr(exact_dedup, "cut", cut)
    got = exact_dedup.without_exact_duplicates(spark.read.parquet(split_table))
    assert got.count() == 25


def test_frames_without_lasting_rows_are_checkpointed(spark, split_table):
    table = spark.read.parquet(split_table)
    narrow = table.select("doc_id", "text").filter("doc_id = 1")
    assert common.stable(table) is table and common.stable(narrow) is narrow
    for odd in (table.repartition(3), table.withColumn("x", explode(array(lit(1), lit(2)))), table.union(table), table.join(table.select("doc_id").distinct(), "doc_id")):
        kept = common.stable(odd)
        assert kept is not odd and common.stable(kept) is kept
        rids = [r["rid"] for r in common.with_rid(kept).collect()]
        assert len(set(rids)) == len(rids) == odd.count()


def test_hot_keys_are_joined_like_others(spark):
    rows = [(i, 0 if i % 3 == 0 else i) for i in range(3000)]
    count = Counter(k for _, k in rows)
    got = common.join_hot(spark.createDataFrame(rows, "id long, k long"), spark.createDataFrame([(k, k * 2, n) for k, n in count.items()], "k long, twice long, n long"), "k", "n", len(rows))
    assert sorted((r["id"], r["k"], r["twice"]) for r in got.collect()) == [(i, k, 2 * k) for i, k in rows]


# The pipeline


def brute_pipeline(data):
    """Rows (doc_id, text, lang, source, n_chars) after each stage, and (doc_id, ids) at the end."""
    rules = [r.replace("AND", "and") for r in quality_rules.RULES.values()]
    kept = [r for r in data if not any(eval(rule, {}, dict(zip(quality_rules.MEASURES, quality_rules.measure(r[1])))) for rule in rules)]
    yield kept
    best = {}
    for r in kept:
        k = r[1].encode().lower()
        if k not in best or best[k][0] < r[0]:
            best[k] = r
    kept = list(best.values())
    yield kept
    grams = {r[0]: {tuple(words(r[1])[i : i + 5]) for i in range(len(words(r[1])) - 4)} for r in kept}
    root = {d: d for d in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if b < a and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    kept = [r for r in kept if root[r[0]] == r[0]]
    yield kept
    *_, times = brute_mix([(r[0], r[1], r[3]) for r in kept])
    kept = [r for i, r in enumerate(kept) for _ in range(times[i])]
    yield kept
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT))
    yield [(r[0], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in kept]


def test_pipeline_matches_brute_force_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 9)))
    data = [(i, " ".join(word() for _ in range(rnd.randrange(20, 300))), "en", None if i % 7 == 0 else f"s{i % 4}", 1) for i in range(60)]
    longest = sorted(data, key=lambda r: -len(r[1]))[:5]
    data += [(100 + k, r[1] + f" {word()}", "en", "s1", 1) for k, r in enumerate(longest)]  # near copies
    data += [(110, data[3][1].upper(), "en", "s1", 1), (111, data[3][1], "fr", "s2", 1), (112, "too short", "en", "s1", 1), (113, None, "en", "s1", 1), (114, "", None, None, None), (115, "ha " * 40, "en", "s1", 1), (116, "## $$ " * 30, "en", "s1", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    expected = list(brute_pipeline([tuple(r) for r in docs.collect()]))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            same(docs.collect(), expected[k])
        else:
            same([(r["doc_id"], tuple(r["ids"])) for r in docs.collect()], expected[k])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    same([(r["doc_id"], tuple(r["ids"])) for r in whole.collect()], expected[-1])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_frames_that_change_between_scans_are_checkpointed(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "t")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("Relation [\nJoin").alias("odd")).write.parquet(path)
    table = spark.read.parquet(path)
    for steady in (table, table.filter("doc_id > 3").select("doc_id", "text"), table.withColumn("name", F.lit("a\nJoin [x]")), common.cut(table)):
        assert common.stable(steady) is steady
    coin = F.udf(lambda: 1, "int").asNondeterministic()
    for loose in (table.filter(F.rand() < 0.5), table.withColumn("r", F.rand()), table.select("doc_id", "text", coin().alias("r")), table.groupBy("doc_id").agg(F.max("text").alias("text")), table.union(table)):
        assert common.stable(loose) is not loose
    half = table.filter(F.rand() < 0.5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        kept = common.stable(half)
        ids = {r.doc_id for r in kept.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # other splits, other random numbers
        assert {r.doc_id for r in kept.collect()} == ids
        assert len({r.rid for r in common.numbered(kept, "rid").collect()}) == len(ids)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _marks():
    import unicodedata

    return [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]


def test_bpe_marks_are_the_librarys(bpe_library):
    """Each combining mark between others, and random strings of marks and letters."""
    own = bpe.load(public_tokenizers.path(bpe.DEFAULT))
    texts = [f"a{chr(c)}{m} a{m}{chr(c)}e" for c in _marks() for m in ("\u0301", "\u0323", "\u0334")]
    rnd = random.Random(6)
    marks = _marks()
    texts += ["".join(chr(rnd.choice([rnd.choice(marks), rnd.randrange(0x61, 0x7B), rnd.randrange(0xC0, 0x3100)])) for _ in range(rnd.randrange(2, 9))) for _ in range(30_000)]
    texts += ["\U00011935\U00011930", "\U00011938", "\U00011938\u0323", "e\U00011930\u0301", "e\u0301\u07fd\u0323"]
    want = [e.ids for e in bpe_library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, w in zip(texts, want) if np.frombuffer(own.encode(t), "<u4").tolist() != w] == []


@pytest.fixture(scope="module")
def bpe_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT))

"""Each operator against a plain restatement, with nulls, empty and long texts, repeats, empty tables and clashing names."""

import collections
import hashlib
import ipaddress
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from reportloom.llm import chat, decontam, langid, lattice, lm, pii, quality, secrets, sentpiece, simhash, tokenfile

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def fails(line):
    """The rules of a line, restated."""
    n, symbols, bangs = len(re.findall(r"[\x20\t-\r]+", line)) + 1, len(re.findall(r"[#*$%&|<>]", line)), line.count("!")
    low = line.translate(LOWER)
    punctuation = (not re.search("[.!?,;:…。]", line) and n >= 8) or (bangs >= 4 and 3 * bangs >= n)
    navigation = (symbols >= 2 and 5 * symbols >= n) or bool(re.search(quality.MENU.replace(r"\z", r"\Z"), low))
    return bool(WORD.search(line)) and (punctuation or navigation or bool(re.search(quality.BOILERPLATE.replace(r"\z", r"\Z"), low)))


def test_quality(docs, texts, empty, clashing):
    got = by_id(quality.assess(docs))
    for i, t in enumerate(t or "" for t in texts):
        w, r = WORD.findall(t), got[i]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        good, lost = [x for x in t.split("\n") if not fails(x)], sum(len(x) for x in lines if fails(x)) / max(1, sum(map(len, lines)))
        assert r["cleaned"] == "\n".join(good) and r["n_bad_lines"] == sum(map(fails, lines)) and math.isclose(r["lost"], lost)
        assert r["kept"] == (not r["base_failed"] and lost <= 0.5)
    assert quality.assess(empty).count() == 0 and quality.assess(clashing).count() == 3


def test_quality_lines(spark):
    good, other = "A plain sentence with more than eight words stands in this line.", "Another one follows it, and no eight words of either are the same."
    rows = [(1, "\n".join([good, "Home | News | About | Contact", "All rights reserved.", "", other])), (2, "\n".join([" | ".join("ABCDEFGHIJKL"), " | ".join("MNOPQRSTUVWX"), "x y."])), (3, "\n".join([good, "  Zurück ", "Accueil", "POLÍTICA de privacidad.", "cookiesalz, gut.", "© Tous droits réservés", other]))]
    got = by_id(quality.assess(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["kept"] and got[1]["n_bad_lines"] == 2 and got[1]["cleaned"] == "\n".join([good, "", other])
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["cleaned"] == "\n".join([good, "cookiesalz, gut.", other])


# 2


def test_language(spark, docs, texts, empty, clashing):
    rng = random.Random(1)
    syllables = {y: own.split() for y, own in {"aa": "ka to mi su ren ha éno ri yo ta", "zz": "stra ght ung ver ßen lich bel ow ent", "qq": "plu gno bri dja wox fim tze kul"}.items()}
    make = lambda y, n=14: " ".join("".join(rng.choice(syllables[y]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."
    rows = [(i, make("aa" if i % 2 else "zz"), "aa" if i % 2 else "zz") for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(known.filter("doc_id < 300"), sample=240)
    got = by_id(langid.predict(known.filter("doc_id >= 300"), model))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[300:]) and sum(r["rejected"] for r in got.values()) == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # a language that wasn't learned, and one of the learned letters in other order
    odd = np.random.default_rng(3)
    foreign = [make("qq", 60) for _ in range(20)] + [langid.shuffled(make("zz", 60), odd) for _ in range(20)]
    told = langid.predict(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()
    assert sum(r["rejected"] for r in told if r["doc_id"] < 20) >= 16 and sum(r["rejected"] for r in told if r["doc_id"] >= 20) >= 16, told
    r = by_id(langid.predict(docs, model))
    assert all((r[i]["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t)) for i, t in enumerate(texts)) and r[0]["score"] == 0
    assert all(r[i]["rejected"] for i, t in enumerate(texts) if not t)
    assert langid.train(empty) is None and langid.predict(docs, None).filter("lang_pred <> 'und' or not rejected").isEmpty()
    assert langid.predict(empty, model).count() == 0
    out = langid.predict(clashing, model)
    assert out.count() == 3 and out.columns.count("score") == 1


def test_language_prediction_by_plain_sums(spark):
    """The score of a text, restated gram by gram."""
    rng = np.random.default_rng(2)
    m = langid.Model(["a", "b"], rng.normal(size=(1 << 8, 3)).astype(np.float32), rng.normal(size=3), 0.7, 20.0, 0.4)
    some = ["Abc, déf!", "x", "a\nb c" * 50, "12", None]
    got = langid.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    for t, r in zip(some, got, strict=True):
        data = (" " + (t or "") + "   ").encode()
        data = bytes(b + 32 if 65 <= b < 91 else 32 if b < 128 and not 97 <= b < 123 else b for b in data)
        z, n = np.zeros(3), 0
        for k in range(len(data) - 3):
            three, four = int.from_bytes(data[k : k + 3], "little"), int.from_bytes(data[k : k + 4], "little")
            for h in (three * 2654435761 % (1 << 32) >> 24, (four ^ 0x5BD1E995) * 2246822519 % (1 << 32) >> 24):
                z, n = z + m.logits[h], n + 1
        z = (z / n + m.bias) / (0.7 + 20 / n)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        letters = bool(t) and any(c.isalpha() for c in t)
        best = int(p[:2].argmax())
        assert r["lang_pred"] == (m.languages[best] if letters else "und")
        assert math.isclose(r["score"], p[best] if letters else 0, rel_tol=1e-5) and r["rejected"] == (not letters or p[best] < 0.4)


def test_samples_are_bounded(spark):
    from reportloom.llm.common import sampled_ids

    rows = [(7, "a")] * 500 + [(i, "ab"[i % 2]) for i in range(1000)] + [(None, "c"), (2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    by = sampled_ids(df.filter("lang is not null"), "doc_id", 60, by="lang").join(df.distinct(), "doc_id").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in by if r["lang"] in ("a", "b")} == {"a": 20, "b": 20}
    assert sampled_ids(df, "doc_id", 50).distinct().count() == 50
    assert sampled_ids(df.filter("lang is not null"), "doc_id", 60, by="lang", most_values=1).count() == 60


# 3


def segmentations(word, v, weights):
    """The summed weight of all ways to cut a marked word into pieces or single characters' bytes, by recursion."""
    ids = {v.pieces[i]: i for i in v.normal.tolist()}
    cache = {len(word): 1.0}
    for k in range(len(word) - 1, -1, -1):
        total = 0.0
        for j in range(k + 1, min(len(word), k + v.longest) + 1):
            part = word[k:j]
            if part in ids:
                total += weights[ids[part]] * cache[j]
            elif j == k + 1:
                total += math.prod(weights[v.byte_ids[b]] for b in part.encode()) * cache[j]
        cache[k] = total
    return cache[0]


def test_lattice(vocabulary_file):
    v = lattice.Vocabulary.load(vocabulary_file)
    scores = lm.start_scores(v)
    weights = np.exp(scores)
    words = ["a", "the", "hello", "zürich", "漢字x", "𐍈q", "tokenization", "e" * 60]
    got = lattice.marginals(lm.spelled_words(words), scores[:-1], v)
    want = [math.log(segmentations("▁" + w, v, weights)) for w in words]
    assert np.allclose(got, want)
    # expected counts: the numerical derivative of the log weight by each piece's log score
    counts = lattice.expected(lm.spelled_words(["hello"]), np.array([2.0]), scores[:-1], v)
    for i in np.argsort(-counts)[:4]:
        moved = scores[:-1].copy()
        moved[i] += 1e-6
        slope = (lattice.marginals(lm.spelled_words(["hello"]), moved, v)[0] - lattice.marginals(lm.spelled_words(["hello"]), scores[:-1], v)[0]) / 1e-6
        assert abs(2 * slope - counts[i]) < 1e-3


def test_expected_counts_of_long_words(vocabulary_file, monkeypatch):
    v = lattice.Vocabulary.load(vocabulary_file)
    scores = lm.start_scores(v)[:-1]
    words = lm.spelled_words(["tokenization" * 8, "e" * 60, "這是一個沒有空格的段落" * 6, "𐍈zürich▁" * 9, "short"])
    times = np.array([2.0, 1.0, 3.0, 1.5, 1.0])
    got = lattice.expected(words, times, scores, v)
    monkeypatch.setattr(lattice, "LONG", 1000)
    assert np.allclose(got, lattice.expected(words, times, scores, v))  # all words at once
    assert got[v.pieces.index("token")] > 1
    small = np.zeros_like(got)  # by stretches shorter than a piece
    for k, n in enumerate(times):
        lattice._long_expected(small, words.flat[words.starts[k] :][: words.sizes[k]], n, scores, v, step=5)
    assert np.allclose(small, got)


@pytest.mark.parametrize("heavy", [0, 40, 1 << 19])
def test_scores(docs, texts, empty, clashing, vocabulary_file, heavy):
    got = by_id(lm.score(docs, vocabulary_file, heavy=heavy))
    split = lambda t: [w.translate(LOWER) for w in WORD.findall(t or "")] + [""]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for i, t in enumerate(texts) if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        r, w = got[i], split(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    test_scores.seen = getattr(test_scores, "seen", None) or {i: r["score"] for i, r in got.items()}
    assert all(math.isclose(r["score"], test_scores.seen[i], rel_tol=1e-9) for i, r in got.items())  # whatever is broadcast
    if heavy == 40:
        assert lm.score(empty, vocabulary_file).count() == 0 and lm.score(clashing, vocabulary_file).count() == 3


def test_weights_follow_training(vocabulary_file):
    v = lattice.Vocabulary.load(vocabulary_file)
    given, used = lm.given_scores(v), np.concatenate([v.normal, v.byte_ids])
    ranked = v.scores[v.normal] > lm.UNRANKED
    assert not ranked.all() and (given[v.normal[ranked]] == v.scores[v.normal[ranked]]).all()
    assert given[v.byte_ids].max() < given[v.normal[~ranked]].max() < given[v.normal[ranked]].min() < 0 and np.ptp(given[used]) < 1e5
    counts = lattice.expected(lm.spelled_words(["the", "language"]), np.array([700.0, 200.0]), lm.start_scores(v)[:-1], v)
    for found in (counts, np.where(np.arange(len(counts)) == v.pieces.index("▁the"), 9.0, 0.0)):
        learned = lm.fitted_scores(given, found, 100.0)
        assert math.isclose(np.exp(learned).sum(), 1) and np.isfinite(learned[used]).all()
        unseen = v.normal[ranked & (found[v.normal] == 0)]
        assert (np.diff(learned[unseen][np.argsort(given[unseen])]) >= 0).all()  # told apart by their own scores
    got = lattice.marginals(lm.spelled_words(["the", "language"]), lm.fitted_scores(given, counts, 100.0)[:-1], v)
    assert np.allclose(np.exp(got), [0.7, 0.2], atol=0.05)


def test_held_out_scores_are_near_the_word_model(spark, vocabulary_file):
    rng = random.Random(5)
    words = "the time of all people who want to make good work with language and new things that they learn".split()
    rows = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=60))) for i in range(200)]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_file).collect() if r["held_out"]]
    assert len(got) > 10 and all(math.isfinite(r["score"]) and r["score"] > 1.1 * r["base_score"] for r in got)


# 4


def plain_fingerprint(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return 0
    parts = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    label = dict.fromkeys(range(len(prints)))
    for i in label:
        if label[i] is None:
            label[i], todo = i, [i]
            while todo:
                a = todo.pop()
                for b in label:
                    if label[b] is None and (prints[a] ^ prints[b]).bit_count() <= radius:
                        label[b] = i
                        todo.append(b)
    return label


def test_simhash(docs, texts, empty, clashing):
    got = by_id(simhash.near_duplicates(docs))
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert {i: got[i]["component_id"] for i in got} == plain_components(prints)
    assert simhash.near_duplicates(empty).count() == 0
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == 3 and {r["component_id"] for r in rows if r["doc_id"] == 1} == {1}


@pytest.mark.parametrize("most", [30, 20_000])
def test_links_connect_what_is_near(spark, most):
    rng = random.Random(2)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centers for _ in range(50)} | {rng.getrandbits(64) for _ in range(80)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)).collect()
    root = {r["node"]: r["root"] for r in edges}
    groups = collections.defaultdict(set)
    for i, k in plain_components(values).items():
        groups[k].add(signed[i])
    for group in groups.values():
        assert {root.get(x, x) for x in group} == {min(group)}


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_bit_planes_agree_with_popcount():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(0b11111)]))
    near = (np.bitwise_count(fps[:, None] ^ fps) <= 4) & ~np.eye(len(fps), dtype=bool)
    i, j = simhash.lagged_links(fps, np.zeros(len(fps), int), 4)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in np.argwhere(near).tolist() if a < b}


# 5


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yö"), (1, 2, "user", "x"), (1, 3, "assistant", "good"), (2, 0, "assistant", "only"), (3, 0, "user", None), (4, 1, "assistant", "b"), (4, 0, "user", "b")]
    whole = chat.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.format_preferences(whole.select("conv_id", F.col("turns").alias("chosen"), chat.echoed(F.col("turns")).alias("rejected"))).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 3 and one["prompt"].count("<|end|>") == 3
    assert one["chosen"] == "<|assistant|>\ngood\n<|end|>\n" and [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["good"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["x"]
    assert got[2]["n_prompt_turns"] == 0 and got[2]["rejected"] == "<|assistant|>\n\n<|end|>\n"
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[4]["n_prompt_turns"] == 2  # equal conversations are all prompt
    pairs = spark.createDataFrame([(1, None, []), (2, [("user", "a"), ("assistant", "b"), ("assistant", "c")], [("user", "a")])], f"conv_id long, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>")
    none, longer = chat.format_preferences(pairs).orderBy("conv_id").collect()
    assert none["prompt"] == none["chosen"] == "" and none["n_prompt_turns"] == 0
    assert longer["n_prompt_turns"] == 1 and len(longer["chosen_mask"]) == 2 and longer["rejected"] == ""
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 6


def test_token_files(docs, texts, empty, clashing, tokenizer_file):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file)
    got, at = by_id(tokenfile.token_table(docs, tokenizer_file, length=64)), 0
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert tokenfile.token_table(empty, tokenizer_file).count() == 0
    rows = tokenfile.token_table(clashing, tokenizer_file).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1]


def test_shards_are_fixed_size_rows(docs, tokenizer_file, tmp_path):
    manifest = tokenfile.write_files(docs, tokenizer_file, str(tmp_path), length=64, shards=2).collect()
    for row in manifest:
        with pa.memory_map(str(tmp_path / f"{row['name']}.arrow")) as source:
            before = pa.total_allocated_bytes()
            table = pa.ipc.open_file(source).read_all()
            assert pa.total_allocated_bytes() - before < 10_000  # views of the file
            assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64)
            masks = np.concatenate([c.values.to_numpy(zero_copy_only=False) for c in table["mask"].chunks])
            assert masks.sum() == row["n_tokens"] and masks[: row["n_tokens"]].all()
        shard = tokenfile.Shard(str(tmp_path), row["name"])
        ids, mask = shard.sequence(0)
        assert len(ids) == len(mask) == 64 and ids.tolist() == shard.ids(0, 64).tolist()
        shard.close()


@pytest.mark.parametrize("text", ["a", " a", "a ", "a  b", "a\n b", "don't  stop\n\n\nx", " a b c", "<|endoftext|> x", "a\tb c", "1 23,4 %%", "é ▁ 😀 q", "x<|endoftext|>  y", "a \x85 b"])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_encoder_equals_the_library(tokenizer_file, text, most):
    encoder = tokenfile.Encoder.of(tokenizer_file)
    ids, counts = encoder.encode(pa.array([text, "", text + "\nb", "z " + text]), 2, encoder.store(most=most))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in (text, "", text + "\nb", "z " + text)]
    assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == list(map(len, want))


def test_units_are_cut_at_marks_and_line_ends(tokenizer_file):
    """A word beside marks, digits and line ends is encoded once, alone or with its space, in ASCII, Latin and Cyrillic letters."""
    encoder = tokenfile.Encoder.of(tokenizer_file)
    words = [a + b for a in ("wort", "été", "слово") for b in itertools.starmap("{}{}".format, itertools.product("abcdefgh", repeat=2))]
    texts = [f"{w} {w}, {w}. ({w}) x-{w}:7{w}\n{w}\n{w}" for w in words]
    store = encoder.store()
    ids, counts = encoder.encode(pa.array(texts), 2, store)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == list(map(len, want))
    assert len(store.place) <= 2 * len(words) + 20  # each word alone and after a space


def test_encoder_of_letters_and_marks_of_many_scripts(tokenizer_file):
    encoder = tokenfile.Encoder.of(tokenizer_file)
    rng = random.Random(29)
    parts = ["a", "The", "s", "re", "'", "'s", '"\'', ".", "(", "-", "42", "é", "Ñ", "ß", "×", "÷", "Привет", "\u0482", "\u0301", "中", "“", "—", "😀", "ª", "²", "Ⅷ", "ა", "\0", "\x1f", "\x7f", "\x85", "\xad", "٣", "\n", "\n\n", "\r\n", "\t", " ", " ", " ", "\xa0", "\u2003", "\u180e", "<|endoftext|>"]
    for k in range(30):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(700)]
        ids, counts = encoder.encode(pa.array(texts), 2, encoder.store(most=k % 2 << 20))
        want = [x.ids + [2] for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == list(map(len, want))


def test_encoder_of_other_vocabularies(tokenizer_file, tmp_path):
    """A vocabulary with a limit, a normalizer or another pattern encodes whole texts, as the library does."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    texts = ["Ab, cd\nef gh.", "", "x", " the ship, and the sea", "a  b\n\nc"]
    for k in range(4):
        other = Tokenizer.from_file(tokenizer_file)
        if k == 0:
            other.enable_truncation(3)
        elif k == 1:
            other.normalizer = normalizers.Replace(", ", ",")
        else:
            other.pre_tokenizer = [pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.Split(",", "isolated")][k - 2]
        other.save(str(tmp_path / f"{k}.json"))
        encoder = tokenfile.Encoder.of(str(tmp_path / f"{k}.json"))
        ids, counts = encoder.encode(pa.array(texts), 2, encoder.store())
        want = [other.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == list(map(len, want)), k


# 7


def test_pii(spark, docs, texts, empty, clashing):
    one = "Mail foo.bar@mail9.example.com, FOO.bar@mail9.example.com; +1 (689) 555-4072 or +1-689-555-4072, card 4111 1111 1111 1111, ip 53.180.13.146. Mrs. Anna Smith met Mr Jones; г-жа Петрова. v4.0."
    df = spark.createDataFrame([(1, one), (2, "again 53.180.13.146 and Mr Jones, 8.8.8.8"), (3, None), (4, ""), (5, "plain 3. 4.0 text")], "doc_id long, text string")
    got = by_id(pii.pseudonymize(df, "k"))
    text = got[1]["text"]
    assert not any(x in text for x in ("foo.bar", "689", "4111 1111", "53.180.13.146", "Smith", "Jones", "Петрова"))
    mails = re.findall(r"\S+@\S+\.com", text)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()
    phones = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", text)
    assert len(phones) == 2 and phones[0] == phones[1]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", text)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0  # still a valid number
    ip = re.search(r"ip (\d+\.\d+\.\d+\.\d+)\.", text)[1]
    assert got[2]["text"].startswith(f"again {ip} and Mr ") and all(int(x) < 256 for x in ip.split("."))
    ends = lambda word, name, script: word.endswith(tuple(pii.ENDINGS[name][script]))
    assert ends(re.search(r"Mrs\. (\w+) \w+ met Mr", text)[1], "given f", 0) and ends(re.search(r"г-жа (\w+)", text)[1], "family f", 1)
    assert text.endswith("v4.0.") and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "plain 3. 4.0 text"
    assert got[1]["n_email"] == got[1]["n_phone"] == 2 and got[2]["n_ip"] == 2
    clean = by_id(pii.pseudonymize(docs, "k"))
    assert all(clean[i]["text"] == t for i, t in enumerate(texts))
    assert pii.pseudonymize(empty, "k").count() == 0 and pii.pseudonymize(clashing, "k").count() == 3
    other = by_id(pii.pseudonymize(df, secret="another"))
    assert other[1]["text"] != text


def test_full_and_short_names_share_a_family_name(spark):
    people = ["Mr John Smith", "Mr Smith", "Mrs. Anna Smith", "Mr Jack Smith", "Mr John Jones", "г-н Иван Петров", "г-н Петров"]
    crowd = [f"Mr {''.join(p).capitalize()} Smith" for p in itertools.product("bcdf", repeat=3)]  # more than the lists have
    df = spark.createDataFrame([(1, " , ".join(people)), (2, " , ".join(crowd)), (3, "Mr Smith")], "doc_id long, text string")
    got = {i: r["text"].split(" , ") for i, r in by_id(pii.pseudonymize(df, "k")).items()}
    john, smith, anna, jack, jones, ivan, petrov = (x.split(" ") for x in got[1])
    assert john[-1] == smith[-1] == anna[-1] == jack[-1] != jones[-1] and ivan[-1] == petrov[-1]
    assert (smith[0], anna[0]) == ("Mr", "Mrs.") and len(smith) == 2 and len(john) == len(ivan) == 3
    assert john[1] == jones[1] != jack[1]
    assert {x.split(" ")[-1] for x in got[2] + got[3]} == {smith[-1]} and len(set(got[2])) == len(crowd)
    assert not {w for i in got for x in got[i] for w in x.split(" ")[1:]} & {w for x in people + crowd for w in x.split(" ")[1:]}


def test_no_part_of_a_name_is_left(spark):
    cases = {  # text: the words that must go
        "Mr O'Brien's dog saw Mr McDonald.": "O'Brien Brien McDonald Donald",
        "Mr. J. R. Smith and Dr Jane Doe": "Smith Jane Doe J. R.",
        "Mrs Mary Smith-Jones wrote; Smith-Jones and Mary Jones signed.": "Mary Smith Jones",
        "Mr John Smith came. Later John Smith, J. Smith and SMITH left Smithfield": "John Smith SMITH J.",
        "Prof. Dr. Anna van der Berg, Ing. Luc D’Arcy": "Anna Berg Luc Arcy",
        "Señora María José García López rief an; García López": "María José García López",
        "Frau Dr. Müller-Lüdenscheidt und Herr K. Ödön": "Müller Lüdenscheidt Ödön K.",
        "г-н Иван Петров. Потом Петров ушёл": "Иван Петров",
    }
    rows = [(i, t) for i, t in enumerate(cases)]
    got = by_id(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    for i, (t, words) in enumerate(cases.items()):
        new = got[i]["text"]
        assert not [w for w in words.split() if re.search(rf"(?<!\w){re.escape(w)}(?!\w)", new)], new
        assert re.sub(r"[\w'’.-]", "", new) == re.sub(r"[\w'’.-]", "", t)  # as many words, the same marks between
    smith = [re.fullmatch(r"Mr (\w+) (\w+) came\. Later (\w+) (\w+), ([A-Z])\. (\w+) and (\w+) left Smithfield", got[3]["text"]).groups()]
    for john, family, again, second, _, third, capitals in smith:
        assert john == again and family == second == third and capitals == family.upper()
    assert "'s dog" in got[0]["text"] and " van der " in got[4]["text"] and got[4]["text"].startswith("Prof. Dr. ")
    mary, one, two, *rest = re.fullmatch(r"Mrs (\w+) (\w+)-(\w+) wrote; (\w+)-(\w+) and (\w+) (\w+) signed\.", got[2]["text"]).groups()
    assert rest == [one, two, mary, two]


def test_names_are_of_one_text(spark):
    """A family name without a title is a mention in the text that has it with one, and a word elsewhere."""
    rows = [(1, "Mr Brown ate Brown bread"), (2, "Brown bread"), (3, "Miss A-B and A-B"), (None, "Mr Brown"), (None, None)]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert got[1] == "Brown bread" and got[4] is None
    title, first, ate, second, bread = got[0].split(" ")
    assert first == second != "Brown" and got[3] == f"Mr {first}" and (title, ate, bread) == ("Mr", "ate", "bread")


def test_addresses_and_local_numbers(spark):
    found = "(030) 1234567 | 0171 2345678 | 030/123456 | 2001:db8::ff00:42:8329 | 2001:0db8:0000:0000:0000:ff00:0042:8329 | FE80::1"
    kept = "12:30:45 | std::vector | ::1 | 2024-01-02 | 0.123 456 | 12:34:56:78"
    rows = [(1, found), (2, kept)]
    got = by_id(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    new, old = got[1]["text"].split(" | "), found.split(" | ")
    assert got[2]["text"] == kept and (got[1]["n_phone"], got[1]["n_ipv6"]) == (3, 3)
    assert all(a != b and re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for a, b in zip(new[:3], old[:3], strict=True))
    assert ipaddress.ip_address(new[3]) == ipaddress.ip_address(new[4]) != ipaddress.ip_address(old[3]) and new[5] == new[5].upper() and ipaddress.ip_address(new[5])


def iban(country, account):
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{country}{98 - number % 97:02d}{account}"


def test_surrogates_stay_distinct(spark):
    names = [f"Mr {''.join(p).capitalize()}" for p in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)]  # all two-letter names
    ips = [f"10.0.{a}.{b}" for a in range(4) for b in range(40)]
    found = pii.entities(spark.createDataFrame([(" , ".join(names + ips),)], "t string"), "t")
    table = pii.dictionary(found, "k").collect()
    assert len(table) == len(names) + len(ips) == len({(r["kind"], r["made"]) for r in table})
    assert not {(r["kind"], r["made"]) for r in table} & {(r["kind"], r["key"]) for r in table}
    text = by_id(pii.pseudonymize(spark.createDataFrame([(1, " , ".join(names)), (2, names[5])], "doc_id long, text string"), "k"))
    made = text[1]["text"].split(" , ")
    assert len(set(made)) == len(names) and text[2]["text"] == made[5]


def test_many_names_are_names(spark):
    """10,000 family names: distinct, of syllables and an ending."""
    names = sorted({"".join(p).capitalize() for p in itertools.product("kstmr", "aeo", "lnvdpg", "iu", "bcfhjqwxz", "aeiouy")})[:10_000]
    assert len(names) > 9000
    docs = spark.createDataFrame([(k, " , ".join(f"Herr {n}" for n in names[k::50])) for k in range(50)], "doc_id long, text string")
    table = {r["key"]: r for r in pii.dictionary(pii.entities(docs, "text"), "k").collect()}
    assert len({r["made"] for r in table.values()}) == len(names) and any(r["tweak"] > 0 for r in table.values())
    syllable = f"(?:[{''.join(pii.ONSETS[0])}][aeiou])"
    shape = re.compile(f"x {syllable}{{2,}}(?:{'|'.join(pii.ENDINGS['family m'][0])})", re.I)
    assert all(shape.fullmatch(r["made"]) and r["made"][2].isupper() for r in table.values())


def test_full_formats_end(spark):
    """Where every number of a format is taken, no surrogate is free of entities; they stay distinct."""
    found = spark.createDataFrame([("ssn", f"{a}") for a in range(100, 1000)] + [("phone", "5"), ("family", "x Ab")], "kind string, key string")
    make = lambda key, kind, secret, tweak: F.when(kind == "ssn", pii.permuted(key, secret, tweak)).otherwise(pii.surrogate(key, kind, secret, tweak))
    full = spark.createDataFrame([("ssn", f"{a:03d}") for a in range(1000)], "kind string, key string")
    table = pii.dictionary(full, "k", rounds=3, make=make).collect()
    assert len({r["made"] for r in table}) == 1000 and {r["tweak"] for r in table} == {3}
    table = pii.dictionary(found, "k", rounds=3, make=make).collect()
    assert len({(r["kind"], r["made"]) for r in table}) == len(table) == 902
    words = [f"x {a}{b}" for a in "ABC" for b in "abcdefgh"]
    last = spark.createDataFrame([("family", w) for w in words], "kind string, key string").select(pii.surrogate(F.col("key"), F.col("kind"), "k", F.lit(pii.ROUNDS)).alias("m"))
    assert len({r["m"] for r in last.collect()}) == len(words)


def test_bank_accounts_and_greek_names(spark):
    good = [iban("DE", f"3704004405320130{k:02d}") for k in range(30)] + [iban("GB", "WEST12345698765432")]
    wrong = [x[:2] + f"{k:02d}" + x[4:] for k in range(0, 100, 7) for x in good[:1] if f"{k:02d}" != x[2:4]]
    text = " , ".join([*good, *wrong, " ".join([good[0][k : k + 4] for k in range(0, len(good[0]), 4)])])
    rows = [(1, text), (2, "Κύριος Νίκος Παππάς και κος Παππάς, Κυρία Παππά; γεια"), (None, "Mr Aa Bb"), (None, "Mr Bb")]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    new = got[0].split(" , ")
    right = lambda x: iban(x[:2], x[4:]) == x
    assert all(map(right, new[: len(good)])) and not any(map(right, new[len(good) : -1])) and len(set(new)) == len(new)
    assert new[-1].replace(" ", "") == new[0] and [x[:2] for x in new] == [x[:2] for x in text.split(" , ")]
    greek = re.fullmatch(r"Κύριος (\w+) (\w+) και κος (\w+), Κυρία (\w+); γεια", got[1])
    assert greek and greek[2] == greek[3] != greek[4] and all("Α" <= c <= "ω" for x in greek.groups() for c in x)
    assert got[2].split(" ")[-1] == got[3].split(" ")[-1] not in ("Bb", "Aa")  # null ids are rows like others


# 8


def best_path(codes, v, unknown):
    """Plain Viterbi over code points."""
    best = [(0.0, None)] + [(-math.inf, None)] * len(codes)
    ids = {v.pieces[i]: i for i in v.normal.tolist()}
    text = ["" if c == lattice.LITERAL_MARK else chr(c) for c in codes]
    for j in range(1, len(codes) + 1):
        for i in range(max(0, j - v.longest), j):
            piece = ids.get("".join(text[i:j])) if all(text[i:j]) else None
            score = v.scores[piece] if piece is not None else unknown if j == i + 1 else -math.inf
            if best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, (i, piece))
    out, j = [], len(codes)
    while j:
        i, piece = best[j][1]
        out = ([piece] if piece is not None else v.byte_ids[list(lattice.utf8_of(codes[i]))].tolist()) + out
        j = i
    return out


@pytest.mark.parametrize("chunk, block", [(1 << 15, 256), (150, 3), (5, 2)])
def test_pieces_round_trip(docs, texts, vocabulary_file, chunk, block):
    some = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < (150 if chunk == 5 else 1 << 20))
    out = sentpiece.decode(sentpiece.encode(some, vocabulary_file, chunk=chunk, block=block), vocabulary_file)
    codec, seen = sentpiece.Codec.of(vocabulary_file), 0
    for i, r in by_id(out).items():
        t = texts[i] or ""
        assert r["text"] == t, i
        assert r["ids"] == (best_path(sentpiece.marked(" " + t).tolist(), codec.vocabulary, codec.unknown) if t else []), i
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seen += 1
    assert seen == some.count()


@pytest.mark.parametrize("chunk", [3, 7, 20, 64])
def test_equal_sums_are_told_apart_alike_however_a_unit_is_cut(vocabulary_file, chunk):
    codec, rng = sentpiece.Codec.of(vocabulary_file), random.Random(5)
    v = codec.vocabulary
    for _ in range(25):
        codes = sentpiece.marked(" " + "".join(rng.choice(rng.choice(["ab", "abc", "the ", "x", "aé漢"])) for _ in range(rng.randint(1, 300))))
        whole = lattice.spelled(codes, lattice.long_best(codes, codec.scores, v, codec.unknown)[1], v)
        assert whole.tolist() == best_path(codes.tolist(), v, codec.unknown)
        cuts = [(a, min(a + chunk, len(codes))) for a in range(0, len(codes), chunk)]
        own = [sentpiece.ChunkSolver(codec, codec.store(), codes[a : b + v.longest - 1], b - a) for a, b in cuts]
        states = [0, *sentpiece.scan_states([x.matrix() for x in own], 0, 0), 0]
        assert np.concatenate([x.trace(*e) for x, e in zip(own, zip(states, states[1:], strict=False), strict=True)]).tolist() == whole.tolist()


def test_a_unit_longer_than_chunks(spark, vocabulary_file):
    """100,000 characters without a space, full of paths of equal score."""
    text = "ab" * 30_000 + "x" * 40_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    codec = sentpiece.Codec.of(vocabulary_file)
    codes = sentpiece.marked(" " + text)
    want = lattice.spelled(codes, lattice.long_best(codes, codec.scores, codec.vocabulary, codec.unknown)[1], codec.vocabulary)
    got = sentpiece.encode(df, vocabulary_file).first()["ids"]
    assert got == want.tolist()


def test_unit_stores_are_emptied():
    from reportloom.llm.common import UnitStore

    def solve(units):
        return np.concatenate([np.full(len(u), ord(u[0])) for u in units]), np.array(list(map(len, units))), np.zeros(len(units))

    store, rng = UnitStore(solve, np.int32, most=2000), random.Random(1)
    for _ in range(50):
        units = list({rng.choice("abcdef") * rng.randint(1, 9) for _ in range(8)})
        at = store.places(units)
        assert store.spelled(at).tolist() == [ord(c) for u in units for c in u] and store.sizes(at).tolist() == list(map(len, units))
        assert store.bytes < 5000


def test_pieces_of_odd_tables(empty, clashing, vocabulary_file):
    assert sentpiece.encode(empty, vocabulary_file).count() == 0
    assert sentpiece.encode(clashing, vocabulary_file, chunk=5).count() == 3


def test_scan_is_associative():
    rng = np.random.default_rng(1)
    # a rank orders a column's entries
    m = [np.stack([rng.integers(-2, 3, (4, 4)), rng.permuted(np.tile(np.arange(4)[:, None], 4), axis=0)]).astype(float) for _ in range(7)]
    assert np.array_equal(sentpiece.combine(sentpiece.combine(m[0], m[1]), m[2]), sentpiece.combine(m[0], sentpiece.combine(m[1], m[2])))
    states = [0, *sentpiece.scan_states(m, 0, 2), 2]
    total = sum(x[0, a, b] for x, a, b in zip(m, states, states[1:], strict=False))
    best = max(sum(x[0, a, b] for x, a, b in zip(m, (0, *p), (*p, 2), strict=True)) for p in itertools.product(range(4), repeat=6))
    assert math.isclose(total, best)


# 9


def low_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def hits_of(t, windows):
    """Positions of hit words, and items."""
    w, hit, found = low_words(t), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                found |= own
                hit |= set(range(k, k + n))
    return hit, found


def test_contamination(spark, docs, texts, empty, clashing):
    rng = random.Random(4)
    long, other = low_words(texts[5]), low_words(texts[8])
    quoted = [low_words(t) for t in texts[3:17]]
    items = [*((20 + i, " ".join(w[2:17])) for i, w in enumerate(quoted) if len(w) > 17), (0, " ".join(long[:20])), (1, " ".join(other[2:7])), (2, None), (3, ""), (4, "In " * 15), (5, other[0]), (6, " ".join(rng.sample(long, len(long)))), (7, " ".join(long[:20])), (8, "É ü ß"), (9, "in " * 200 + "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    assert sum(bool(hits_of(t, windows)[0]) for t in texts) > 5  # the sample has hits to find
    got = by_id(decontam.contamination(docs, bench))
    for i, t in enumerate(texts):
        w, (hit, found), r = low_words(t), hits_of(t, windows), got[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)), i
    none = bench.filter("false")
    assert decontam.contamination(docs, none).filter("n_hit > 0").isEmpty() and decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(clashing, bench).count() == 3


def test_repetitive_texts_meet_as_few_rows(spark):
    bench = spark.createDataFrame([(i, "ab " * 3000) for i in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ab " * 5000 + "c"), (2, "ab " * 12)], "doc_id long, text string")
    prints = decontam.item_prints(bench, "item_id", "text", 13, 6)
    assert prints.select("fp", "ctx").distinct().count() < 20
    got = by_id(decontam.contamination(docs, bench))
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"]) == (5001, 5000, ["0", "1", "2"]) and got[2]["n_hit"] == 0


def test_winnowing_keeps_one_hash_of_each_window():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 4, 300).astype(np.uint64)
    counts = np.array([5, 100, 0, 13, 182])
    kept, hashes = decontam.winnowed(words, counts, 6, 13)
    all_hashes, want = decontam.grams(words, 6), set()
    for a, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        for i in range(a, a + n - 12):
            want.add(max(range(i, i + 8), key=lambda j: (-int(all_hashes[j]), j)))
    assert kept.tolist() == sorted(want) and np.array_equal(hashes, all_hashes[kept])


# 10


def test_secrets(spark, docs, texts, empty, clashing):
    a = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
    made = []
    for i in range(120):
        plain = texts[3 + i % 14]
        secret = [f'token = "{hexes(40)}"', f"password={hexes(18)}", keys(), "", "a 53.1.2.3 b"][i % 5]
        made.append((i, f"{plain} é {secret} {plain}"))
    made += [(200, "secret: token = abcdef1"), (201, "tokenapikey:short API-key=x, ApiKey : 'abc/def+1'"), (202, hexes(24) + " " + hexes(23)), (203, "AKIA" + "A" * 15), (204, "AKIAAKIA" + "B" * 13), (205, None), (206, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    field = secrets.train_field(df.filter("doc_id < 100"))
    got = by_id(secrets.scan(df, field))
    for i, t in ((i, t or "") for i, t in made):
        want = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in got[i]["spans"]]
        assert [s for s in spans if s[1] < 3] == sorted(want), i
        if i < 120 and i % 5 > 2:
            assert not spans, t
    # kinds that neither the patterns nor training know, in texts without other matches
    alnum = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    some = lambda n: "".join(rng.choice(alnum) for _ in range(n))
    fresh = [f"ghp_{some(36)}", f"sk_live_{some(24)}", f"AIza{some(35)}", "-".join(hexes(n) for n in (8, 4, 4, 4, 12)), f"eyJ{some(30)}.{some(60)}.{some(43)}"]
    new = [(k, f"{texts[3 + k % 14]} {fresh[k % 5]} {texts[3 + (k + 1) % 14]}") for k in range(40)] + [(100 + k, texts[3 + k]) for k in range(14)]
    found = by_id(secrets.scan(spark.createDataFrame(new, "doc_id long, text string"), field))
    hit = 0
    for k, t in new[:40]:
        at = t.index(fresh[k % 5])
        hit += any(s["kind"] == "crf" and s["start"] <= at and s["end"] >= at + len(fresh[k % 5]) for s in found[k]["spans"])
    assert hit >= 36 and all(found[100 + k]["spans"] == [] and found[100 + k]["n_tagged"] == 0 for k in range(14))
    assert secrets.scan(empty, field).count() == 0 and secrets.scan(clashing, field).count() == 3
    assert by_id(secrets.scan(docs, secrets.train_field(empty)))[5]["spans"] == []
    clean = secrets.redacted(df, field).filter("doc_id = 0").first()["text"]
    assert "[SECRET]" in clean and "token" not in clean


def test_viterbi_and_training_against_enumeration():
    rng = np.random.default_rng(3)
    field = secrets.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)))
    e = rng.normal(size=(5, 3))
    steps = field.step + secrets._NEVER
    value = lambda p: sum(e[t, y] for t, y in enumerate(p)) + steps[0, p[0]] + sum(steps[x, y] for x, y in zip(p, p[1:], strict=False)) + steps[p[-1], 0]
    best = max(itertools.product(range(3), repeat=5), key=value)
    assert tuple(secrets.viterbi(e, field.step)) == best
    data, offsets = np.frombuffer(b"a Bc1 token= x9", np.uint8), np.array([0, 15])
    words = secrets.words_of(data, offsets)
    own = secrets.Field(rng.normal(size=(secrets.Field.height(), 3)), np.zeros((3, 3)))
    assert np.allclose(own.emissions(words), own.emit[secrets.Field.rows(words)].sum(axis=1))


def test_tags_are_those_of_whole_texts(monkeypatch):
    def spans(e, field, counts):
        monkeypatch.setattr(secrets.Field, "emissions", lambda self, words: e)
        n = len(e)
        return secrets.tagged(secrets.Words(np.arange(n), np.arange(n) + 1, np.array(counts), np.zeros((n, 10), np.int32), np.zeros((len(counts), 2), np.int32)), field)

    def whole(e, field, counts):
        out, lo = [], 0
        for n in counts:
            tags = secrets.viterbi(e[lo : lo + n], field.step).tolist() if n else []
            out += [(lo + k, lo + k + len(list(itertools.takewhile(lambda x: x == 2, tags[k + 1 :])))) for k, x in enumerate(tags) if x == 1]
            lo += n
        return out

    # a span may begin, or end, with a word that isn't promising itself
    plain = secrets.Field(np.zeros((1, 3)), np.zeros((3, 3)))
    assert spans(np.array([[0, -9, -9], [0, -1, -9], [0, -4, 6], [0, -9, -9.0]]), plain, [4]) == [(1, 2)]
    costly = secrets.Field(np.zeros((1, 3)), np.array([[0, 0, 0], [-5, 0, 0], [0, 0, 0.0]]))
    assert spans(np.array([[0, -9, -9], [0, 3, -9], [0, -9, -1], [0, -9, -9.0]]), costly, [4]) == [(1, 2)]
    rng = np.random.default_rng(8)
    seen = 0
    for _ in range(400):
        counts = rng.integers(0, 9, 4).tolist()
        e = rng.normal(size=(sum(counts), 3)) * 3 - [0, rng.uniform(0, 4), rng.uniform(0, 4)]
        field = secrets.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)) * 2)
        assert spans(e, field, counts) == whole(e, field, counts)
        seen += len(whole(e, field, counts))
    assert seen > 100


def test_field_spans_beside_matches(monkeypatch):
    texts = pa.array(["my password=hunter2!xyz é", 'a token = "abcdefg" b', "é key password=hunter2 Xy7 c", "plain"])
    spans = {(1, 1), (4, 6), (9, 11)}  # by position among all words
    monkeypatch.setattr(secrets, "tagged", lambda words, field: sorted(spans))
    got = secrets.spans_of(texts, None)
    parts = [[(s["kind"], t[s["start"] : s["end"]]) for s in own] for t, own in zip(texts.to_pylist(), got, strict=True)]
    assert parts[0] == [("assign", "password=hunter2"), ("crf", "password=hunter2!xyz")]
    assert parts[1] == [("assign", 'token = "abcdefg')]  # the field adds nothing
    assert parts[2] == [("crf", "key password=hunter2 Xy7"), ("assign", "password=hunter2")]
    assert secrets._replaced(texts[0].as_py(), got[0], "[SECRET]") == "my [SECRET] é"
    assert secrets._replaced(texts[2].as_py(), got[2], "[SECRET]") == "é [SECRET] c"


def test_token_files_encode_batches_of_odd_white_space(tokenizer_file):
    """Texts of all white space, alone, first in a text and beside others of a batch, are encoded as the library does."""
    encoder = tokenfile.Encoder.of(tokenizer_file)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = random.Random(17)
    for _ in range(40):
        texts = [" ", " \t", *("".join(rng.choice([*spaces, " ", " ", "a", "é.", "'s"]) for _ in range(rng.randrange(6))) for _ in range(700))]
        ids, counts = encoder.encode(pa.array(texts), 2, encoder.store())
        want = [x.ids + [2] for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == list(map(len, want))


def test_field_does_not_depend_on_partitions_and_leaves_ordinary_shapes(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    said = lambda n: [word(rng.randint(2, 9)) for _ in range(n)]
    rows = [(i, " ".join(said(40)) + (f' token = "{rng.randbytes(20).hex()}" ' if i % 5 == 0 else " ") + " ".join(said(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fields = [secrets.train_field(df.repartition(n)) for n in (1, 3, 8)]
    for name, value in vars(fields[0]).items():
        for other in fields[1:]:
            assert np.array_equal(value, getattr(other, name)) if isinstance(value, np.ndarray) else value == getattr(other, name), name
    shapes = ["10.1038/s41586-020-2649-2", "978-3-16-148410-0", "https://example.org/wiki/page", "/usr/local/lib/file.py", "1.26.4", "+49 30 1234567"]
    texts = [(len(shapes) * k + j, " ".join(said(20)) + f" {s} " + " ".join(said(20))) for k in range(5) for j, s in enumerate(shapes)]
    got = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"), fields[0]).collect()
    assert sum(bool(r["spans"]) for r in got) <= 1


def test_language_counts_are_not_clipped(spark):
    df = spark.createDataFrame([(1, "ab " * 90_000, "x"), (2, "cd " * 5, "y")], "doc_id long, text string, lang string")
    found = langid.training_examples(df, "doc_id", "text", "lang", 10, 10)
    assert max(int(n.max()) for _, n, _, _ in found) >= 90_000


def test_language_examples_are_small(spark):
    """Counts come to the driver packed and lie there in a byte each where they fit, and examples stand in one order."""
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(300)), "xy"[i % 2]) for i in range(40)]
    rows += [(50 + i, *rows[0][1:]) for i in range(2)] + [(60, "ab " * 90_000, "x")]
    found = langid.training_examples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 100, 10)
    small = [x for x in found if x[1].max() < 256]
    assert len(small) > 40 and all(at.nbytes + n.nbytes == 3 * len(at) for at, n, _, _ in small)
    whole = [(y or "", c, zlib.crc32(at.tobytes()), at.tobytes(), n.astype("<u4").tobytes()) for at, n, y, c in found]
    assert whole == sorted(whole)
    for at, n in [langid.counted(rows[0][1]), langid.counted(rows[-1][1]), (np.array([0, 1, 65535]), np.array([1, 300, 1 << 20]))]:
        sent = langid.packed(at, True), langid.packed(n, False)
        assert (langid.unpacked(sent[0], True) == at).all() and (langid.unpacked(sent[1], False) == n).all()

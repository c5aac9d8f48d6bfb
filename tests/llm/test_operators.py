"""The training-data operators against brute force on small fixtures with nulls, ties, copies and empty tables."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, uid long, part long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = para(60)
    out = [None, "", " \n\t", "one", "a b", "é ü ß 🎉 é", para(80), para(80), f"{para(30)} {shared} {para(20)}", f"{para(40)} {shared}"]
    base = para(120)
    out += [base, base, " ".join(base.split()), base.replace(" ", "\n", 3)]
    for k in range(4):
        w = base.split()
        w[rng.randrange(len(w))] = f"changed{k}"
        out.append(" ".join(w))
    out += ["x" * 450, "ab" * 300, " ".join(["same line\n"] * 40), para(6000), "THE Mail me@x.org, 4111 1111 1111 1111 and +1 (017) 555-7713 at 10.0.0.1."]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], 0, -i, "x", 5, 6) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, empty, digest_bytes):
    from tessera.llm.exact_dedup import exact_dedup

    got = {r["doc_id"]: r for r in exact_dedup(docs, digest_bytes=digest_bytes, memtable_rows=4).collect()}
    all_ = dict(enumerate(texts()))
    for i, t in all_.items():
        group = [j for j, u in all_.items() if bare(u) == bare(t)]
        best = min(group, key=lambda j: (-len(all_[j] or ""), j))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(group), i == best, hashlib.sha256(bare(t).encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_rows(docs):
    from tessera.llm.exact_dedup import exact_dedup

    r = exact_dedup(docs.union(docs)).where("kept").collect()
    assert len(r) == len({bare(t) for t in texts()})


@pytest.mark.parametrize(("hot_least", "levels"), [(1024, 4), (1, 1), (1, 3)])
def test_suffix_dedup(docs, empty, hot_least, levels):
    from tessera.llm.suffix_dedup import suffix_dedup

    rows = [(t or "").encode() for t in texts()]
    seen = Counter(b[k : k + 200] for b in rows for k in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup(docs, part_bytes=4000, hot_least=hot_least, levels=levels).collect()}
    for i, b in enumerate(rows):
        m = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                m[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup(empty).count() == 0


def test_suffix_dedup_hot_passage(spark):
    """A passage common to many rows with different text about it, whole and cut, repeated rows and null ids."""
    from tessera.llm.suffix_dedup import suffix_dedup

    rng = random.Random(6)
    passage = " ".join(str(rng.random()) for _ in range(30))
    texts_ = [f"{rng.random()} {passage[rng.choice([0, 0, 3, 250]) :]} {rng.choice(['x', 'y'])}{rng.random()}" for _ in range(90)]
    rows = [(None if i % 7 == 0 else i, t) for i, t in enumerate(texts_)] + [(3, texts_[3]), (None, None)]
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, raw, strict=True):
        m = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                m[k : k + 200] = b"\1" * 200
        want.append((str(i), len(b), sum(m), len(re.findall(b"\1+", bytes(m)))))
    for levels in (4, 0):
        got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), part_bytes=20_000, hot_least=5, levels=levels).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == sorted(want)


def test_refine_buckets():
    from tessera.llm.suffix_dedup import refine_buckets

    rng = random.Random(1)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 60))) for _ in range(30)]
    segments += [segments[0][:40] + b"zz", b"q" * 50]
    seen = Counter(s[k : k + 30] for s in segments for k in range(len(s) - 29))
    for s, flags in zip(segments, refine_buckets(segments, 30), strict=True):
        assert flags.tolist() == [seen[s[k : k + 30]] > 1 for k in range(len(s) - 29)]


def shingles(t):
    w = [x.lower() for x in WORD.findall(t or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(docs, empty):
    from tessera.llm.chosen_path import near_dedup

    sets = [shingles(t) for t in texts()]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r for r in near_dedup(docs).collect()}
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), root[i], i == root[i])
    assert near_dedup(empty).count() == 0


def test_near_dedup_large_group(spark):
    """A group larger than a small node, alike in chains rather than to one centre."""
    from tessera.llm.chosen_path import near_dedup

    rng = random.Random(2)
    w = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(260):
        w[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_mixing(docs, empty):
    from tessera.llm.mixing import mix

    got = mix(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(5)).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts())}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and {r["doc_id"]: r["taken"] for r in got} == again
    source = {i: ["s0", "s0", "s1", None][i % 4] for i in sizes}
    total = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in ("s0", "s1", None)}
    target = {source[r["doc_id"]]: r["target"] for r in got}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in total:
        taken = sum(r["taken"] for r in got if source[r["doc_id"]] == s)
        assert target[s] <= 2 * total[s] + 1e-9 and abs(taken - target[s]) <= 64 * 3
    assert mix(empty).count() == 0


def test_quality_rules(docs, empty):
    from tessera.llm.quality_rules import quality_rules

    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(win)
        covered = {p + d for p, x in enumerate(win) if n[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules(empty).count() == 0


def test_hmm(docs, empty):
    from tessera.llm.hmm import Hmm, hmm_scores

    got = {r["doc_id"]: r for r in hmm_scores(docs, rounds=2).collect()}
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts())}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(x for i, w in toks.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * max(1, abs(r["base_score"]))
        assert np.isfinite(r["score"])
    assert hmm_scores(empty).count() == 0
    # Scaled forward recursion against the sum over all paths.
    rng = np.random.default_rng(0)
    m = Hmm.initial(rng.integers(1, 9, 5).astype(float), 2)
    seq = np.array([0, 3, 1, 4], np.uint16)
    total = 0.0
    for path in range(16):
        s = [(path >> k) & 1 for k in range(4)]
        p = m.start[s[0]] * m.emit[seq[0], s[0]]
        for k in range(1, 4):
            p *= m.move[s[k - 1], s[k]] * m.emit[seq[k], s[k]]
        total += p
    assert abs(m.forward([seq])[0] - np.log(total)) < 1e-9


def test_hmm_expected_counts():
    """Stretches change nothing: counts as by plain forward-backward over each whole sequence; likelihood rises."""
    from tessera.llm.hmm import Hmm

    rng = np.random.default_rng(4)
    m = Hmm.initial(rng.integers(1, 9, 7).astype(float), 3)
    sequences = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 5, 40, 64, 10, 11, 137)]

    def plain(seq):
        alpha, beta = [m.start * m.emit[seq[0]]], [np.ones(3)]
        for x in seq[1:]:
            alpha.append(alpha[-1] @ m.move * m.emit[x])
        for x in seq[:0:-1]:
            beta.insert(0, m.move @ (m.emit[x] * beta[0]))
        p = alpha[-1].sum()
        gamma = [a * b / p for a, b in zip(alpha, beta, strict=True)]
        move, emit = np.zeros((3, 3)), np.zeros((7, 3))
        for t in range(len(seq) - 1):
            move += np.outer(alpha[t], m.emit[seq[t + 1]] * beta[t + 1]) * m.move / p
        for x, g in zip(seq, gamma, strict=True):
            emit[x] += g
        return np.concatenate([gamma[0], move.ravel(), emit.ravel()]), np.log(p)

    want = [plain(x) for x in sequences]
    for stretch in (1000, 10, 3, 1):
        counts, ll = m.expected(sequences, stretch)
        assert np.allclose(counts, sum(w[0] for w in want), atol=1e-8) and abs(ll - sum(w[1] for w in want)) < 1e-8
    last = -np.inf
    for _ in range(8):
        counts, ll = m.expected(sequences, 16)
        assert ll >= last - 0.2  # smoothing of the counts may cost a little
        last, m = ll, Hmm.from_counts(counts, 3)
    assert last > sum(w[1] for w in want)


def test_hmm_scores_of_one_state(spark):
    """With one state a document's score is a product of smoothed word shares; unseen words are in hash classes."""
    from tessera.llm.hmm import CLASSES, hmm_scores

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 1500)))) for i in range(60)] + [(None, "a b zzz"), (None, "a b zzz"), (3, None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in [*(t or "").split(), None])
    n, classes = sum(c.values()), CLASSES + len(c)
    got = hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=1, rounds=2, min_own=1).collect()
    want = [sum(math.log10((c[w] + 0.01) / (n + 0.01 * classes)) for w in [*(t or "").split(), None]) for i, t in rows]
    assert len(got) == len(rows)
    assert np.allclose(sorted(r["score"] for r in got), sorted(want), rtol=1e-6, atol=1e-6)


def test_packing(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack, plan_bins

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack(docs, path).collect()
    tok = Tokenizer.from_file(path)
    by = {(r["doc_id"], r["piece"]): r for r in rows}
    n = 0
    for i, t in enumerate(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own, r = ids[k : k + 2048], by[i, k // 2048]
            n += 1
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert n == len(rows)
    used: dict = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(empty, path).count() == 0
    assert plan_bins({5: 2, 3: 2, 2: 3}, 10) and sum(k for _, k in plan_bins({6: 10, 4: 10}, 10)) == 10


def test_word_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tessera.llm.packing import WordIds

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("It's İstanbul don't <|endoftext|> x×y 5€ naïve ＦＵＬＬ \x1c a\x85b a\xa0b ΣΑΣ é ﬁ 三 🎉 'S we'Re ŉ ß", "", "\t\n"):
        own = b"".join(ids[w] for w in t.encode().split())
        assert np.frombuffer(own, "<u4").tolist() == ids.whole.encode(t, add_special_tokens=False).ids


def test_word_ids_keep_words_met_again():
    """A full table forgot the common words with the rare ones, and they were merged anew."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tessera.llm.packing import WordIds

    ids, merged = WordIds(public_tokenizers.path("word_bpe_49k.json"), most=20), []
    merge = ids.merge
    ids.merge = lambda text: merged.append(text) or merge(text)
    for i in range(300):
        rare = "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "qz"
        for w in (rare, "common", "Common,"):
            assert np.frombuffer(ids[w.encode()], "<u4").tolist() == ids.whole.encode(w, add_special_tokens=False).ids
    assert merged.count("common") == 1 and len(ids) + len(ids.old) <= 40


def test_pii(docs, empty):
    from tessera.llm.pii import pii_report, redact

    got = {r["doc_id"]: r for r in pii_report(docs).collect()}
    last = len(texts()) - 1
    assert [got[last][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert all(got[i]["spans"] == "" for i in range(last))
    assert "me@x.org" not in redact(docs).where(f"doc_id = {last}").first()["text"]
    assert pii_report(empty).count() == 0


def test_pii_against_patterns():
    from tessera.llm.pii import automaton, find_spans, luhn

    rng = random.Random(3)
    a = automaton()
    for _ in range(3000):
        t = "".join(rng.choice("a.@+-1 2.0(_é") for _ in range(rng.randint(0, 40)))
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            want += [(2, m.start(), m.end())] if 16 <= len(d) <= 19 and luhn(d) else []
        want += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [s for s in find_spans(t, a) if s[0] < 4] == want, t


def test_pii_url_accounts():
    """URLs with a user or a ~ part, against a plain reading of each scheme; a long unbroken run of URLs takes no longer."""
    import time

    from tessera.llm.pii import automaton, find_spans

    a, rng = automaton(), random.Random(5)

    def plain(t):
        out, done = [], 0
        for m in re.finditer(r"https?://|ftp://", t):
            rest = re.match(r"[^\x00-\x20\"'<>]*", t[m.end() :]).group()
            if m.start() >= done and len(rest) > 2 and ("@" in rest.split("/", 1)[0][1:] or "/~" in rest):
                done = m.end() + len(rest)
                out.append((4, m.start(), done))
        return out

    for _ in range(2000):
        t = "".join(rng.choice(["http://", "ftp://", "a", "@", "/", "~", "/~u", " ", "x.y", "<"]) for _ in range(rng.randrange(12)))
        assert [s for s in find_spans(t, a) if s[0] == 4] == plain(t), t
    began = time.time()
    find_spans("http://a/b" * 100_000, a)
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["suffix_dedup", "mix", "pii_report", "quality_rules", "hmm_scores", "near_dedup", "exact_dedup"])
def test_repeated_rows_null_ids_and_clashing_columns(spark, name):
    """Every row has its result, equal rows have equal ones (kept apart, of which one row of a group has more)."""
    from tessera.llm.exact_dedup import exact_dedup  # noqa: F401
    from tessera.llm.hmm import hmm_scores  # noqa: F401
    from tessera.llm.chosen_path import near_dedup  # noqa: F401
    from tessera.llm.mixing import mix  # noqa: F401
    from tessera.llm.pii import pii_report  # noqa: F401
    from tessera.llm.quality_rules import quality_rules  # noqa: F401
    from tessera.llm.suffix_dedup import suffix_dedup  # noqa: F401

    own = [t for t in texts() if len(t or "") < 2000]
    rows = [(None if i % 5 == 0 else i, t, "en", None if i % 4 else "s", True, "x", 1, b"z", 2.0) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, kept boolean, node string, uid int, digest binary, score double")
    got = locals()[name](df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows * 2)
    if name not in ("mix", "exact_dedup"):
        each = Counter(map(str, got))
        assert all(n % 2 == 0 for n in each.values())


def test_warc(spark):
    from tessera.llm.warc import round_trip

    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u\n", ""), (5, "http://c", "é" * 5000), (6, "x", "same"), (None, "n", "same")]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 7 and all(r["verified"] for r in got)
    assert [by[i]["record_type"] for i in (1, 2, 3, 4, 5, 6, None)] == ["revisit", "revisit", "revisit", "response", "response", "response", "response"]
    assert by[1]["refers_to"] == 6 and by[3]["refers_to"] == 4 and by[5]["payload_bytes"] == 10000
    assert by[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_conv_quality(spark, empty):
    from tessera.llm.conv_quality import score, train

    rng = random.Random(8)
    rows = [(i, " ".join(("word" if i % 2 else "W###!") + rng.choice("abc") for _ in range(40))) for i in range(160)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(3, None)], "doc_id long, quality int")
    got = score(docs, train(docs, labels)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 160]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    assert score(empty, train(docs, labels)).count() == 0


def test_pipeline_stages(spark, docs, empty):
    """Each stage against a brute-force version of what it keeps, on rows that repeat and with ids that are null."""
    import corpus_pipeline

    all_ = dict(enumerate(texts()))
    judged = brute_quality([(t, ["en", "fr", None][i % 3]) for i, t in all_.items()])
    good = corpus_pipeline.quality_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in good.collect()) == [i for i, x in enumerate(judged) if x[2]]

    extra = spark.createDataFrame([(None, "one", "en", "s0", 0, 1, "x", 5, 6), (None, "only here", "en", "s0", 0, 1, "x", 5, 6)], SCHEMA)
    kept = corpus_pipeline.exact_stage(spark, docs.union(docs).union(extra), "")
    first = {}
    for i, t in all_.items():
        first.setdefault(bare(t), []).append((-len(t or ""), i))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(False, min(v)[1]) for v in first.values()] + [(True, 0)])

    near = corpus_pipeline.near_stage(spark, docs, "")
    root = components_of([shingles(t) for t in texts()])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(root.values()))

    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 2 and all(WORD.search(all_[i] or "") for i in times)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, "").count() == 0, name


def test_pipeline_run(spark, docs, tmp_path):
    """All stages in a row: the packed pieces are the tokens of the rows that the stages before keep."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs.withColumn("kept", docs["id"] > 3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, "")
    left = Counter(r["doc_id"] for r in rows.collect())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, n in left.items():
        ids = len(tok.encode(texts()[i] or "", add_special_tokens=False).ids) + 1
        want.update({(i, k, min(2048, ids - 2048 * k)): n for k in range(-(-ids // 2048))})
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def components_of(sets):
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(sets))}


@pytest.mark.parametrize(("changes", "sizes"), [([1] * 50 + [4, 5, 6, 7, 8] * 6, {}), ([2, 3] * 60, {"MINOR": 8, "BLOCK": 16}), ([3] * 500, {"SMALL": 32, "MINOR": 256})])
def test_near_dedup_large_nodes(spark, monkeypatch, changes, sizes):
    """Groups about the threshold, in nodes too large to compare at once; sets are linked as brute force links them."""
    from tessera.llm import chosen_path

    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for n in changes:
        own = list(base)
        for at in rng.sample(range(200), n):
            own[at] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    for name, value in ({"SMALL": 4} | sizes).items():
        monkeypatch.setattr(chosen_path, name, value)
    want = components_of([shingles(t) for t in rows])
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want


def test_near_dedup_relations(spark, monkeypatch):
    """A set may be alike with one member of a component only, which is not the one it is most alike with by sketch."""
    from tessera.llm import chosen_path

    rng = random.Random(9)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 3, 4])):
            own[at] = f"n{i}x{at}"
        rows.append(" ".join(own))
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    assert chosen_path.trees_for(0.9998) == 12
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == components_of([shingles(t) for t in rows])


def test_keep_one(spark):
    """One row of a component stays, also where ids repeat or are null; columns named as the operator's own come back."""
    from tessera.llm.chosen_path import keep_one

    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    rows = [(None, a, 1), (None, f"{a} more", 2), (None, b, 3), (5, f"{b} x", 4), (5, f"{b} x", 5), (7, a, 6), (None, None, 7), (None, "", 8), (5, "alone", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keeper int").repartition(3)
    got = keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(r["keeper"] for r in got.collect())
    assert kept in ([4, 6, 7, 8, 9], [5, 6, 7, 8, 9])
    assert keep_one(docs.limit(0)).count() == 0


CLASS_OF = (lambda c: unicodedata.category(c) == "Ll", lambda c: unicodedata.category(c) == "Lu", lambda c: unicodedata.category(c) == "Nd", lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>@^~_=+/\\{}[]")


def brute_quality(rows: list) -> list:
    """(class_distance, word_distance, kept) of rows (text, lang) by op5's rules, in plain Python."""

    def classes(t):
        n = [sum(map(f, t)) for f in CLASS_OF]
        return [*n, len(t) - sum(n)]

    def shares(n):
        return [x / max(sum(n), 1) for x in n]

    def distance(n, q):
        p = shares(n)
        terms = [x * math.log2(x / ((x + y) / 2)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x > 0]
        return round(math.sqrt(max(sum(terms) / 2, 0)), 6) if sum(n) else 0.0

    def reference(lang):
        of = [t or "" for t, g in rows if lang is None or g == lang]
        w = Counter(x for t in of for x in WORD.findall(t.lower()))
        top = sorted(w, key=lambda x: (-w[x], x))[:24]
        return [sum(c) for c in zip([0] * 7, *(classes(t) for t in of if WORD.search(t)), strict=True)], top, histogram(w, top)

    def histogram(w, top):
        n = [w[x] for x in top] + [0] * (24 - len(top))
        return [*n, sum(w.values()) - sum(n)]

    refs, out = {g: reference(g) for g in {g for _, g in rows}}, []
    for t, g in rows:
        t, (c, top, n) = t or "", refs[g]
        words = WORD.findall(t)
        win = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(win)
        covered = {p + k for p, x in enumerate(win) if seen[x] > 1 for k in range(3)}
        a, b = distance(classes(t), shares(c)), distance(histogram(Counter(x.lower() for x in words), top), shares(n))
        out.append((a, b, len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and a <= 0.28 and b <= 0.45))
    return out


def sainte_lague(claims, seats, limits):
    """Seats one by one to the highest quotient; ties to the earlier party."""
    quota = [0] * len(claims)
    for _ in range(seats):
        open_ = [k for k in range(len(claims)) if quota[k] < limits[k]]
        if not open_:
            break
        k = max(open_, key=lambda k: (claims[k] / (2 * quota[k] + 1), -k))
        quota[k] += 1
    return quota


def test_apportion_against_single_seats(spark):
    from tessera.llm._common import Workspace
    from tessera.llm.mixing import apportion

    rng = random.Random(3)
    groups = {g: [rng.choice([0, 1, 7, 7, 50, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 40))] for g in range(6)}
    seats = {g: rng.randrange(0, 400) for g in groups}
    rows = [(g, 100 * g + k, seats[g], float(c), 10**6) for g, own in groups.items() for k, c in enumerate(own)]
    df = spark.createDataFrame(rows, "g long, party long, seats long, claim double, most_of long").withColumnRenamed("most_of", "limit")
    got = {(r["g"], r["party"]): r["quota"] for r in apportion(df.withColumnRenamed("g", "of"), "of", "seats", "claim", "limit", Workspace(spark, "test"), "t").withColumnRenamed("of", "g").collect()}
    for g, own in groups.items():
        want = sainte_lague(own, seats[g], [10**6] * len(own)) if sum(own) else None
        if want:
            assert [got[g, 100 * g + k] for k in range(len(own))] == want, g


def test_target_levels(spark):
    from tessera.llm.mixing import target_levels

    rng = random.Random(11)
    sizes = [rng.choice([0, 3, 40, 500, 90_000]) for _ in range(30)]
    weight = [(5, 2, 1)[k % 3] for k in range(30)]
    total, cap = 1.5 * sum(sizes), [2 * s for s in sizes]
    full: set = set()
    while True:
        rate = (total - sum(cap[k] for k in full)) / sum(w for k, w in enumerate(weight) if k not in full)
        more = {k for k in range(30) if k not in full and cap[k] < rate * weight[k]}
        if not more:
            break
        full |= more
    rows = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(zip(sizes, weight, strict=True))], "k int, source_size long, weight int")
    got = {r["k"]: r["target"] for r in target_levels(rows, total, 2).collect()}
    assert all(abs(got[k] - (cap[k] if k in full else rate * weight[k])) < 1e-6 for k in range(30))


def test_mixing_hot_source_and_shards(spark):
    """Many shards, null ids and repeated rows: every source near its target, whole blocks by the shards' quotas."""
    from tessera.llm.mixing import mix

    rng = random.Random(7)
    rows = [(i if i % 9 else None, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, shard_rows=16, block=8).collect()
    again = mix(docs.repartition(7), shard_rows=16, block=8).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["target"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 420
    for t in {r["target"] for r in got}:
        own = [r for r in got if r["target"] == t]
        shards = -(-len(own) // 16) + 1
        assert abs(sum(r["taken"] for r in own) - t) <= 8 * 3 * shards and all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def covered_words(w):
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(win)
    return len({p + d for p, x in enumerate(win) if n[x] > 1 for d in range(3)})


def test_repeated_words_when_hashes_collide(spark):
    """The first two windows have equal upper hash bits; sorted by hash they would lie between the repeats."""
    from tessera.llm.quality_rules import quality_rules

    a, b = "x326532 y z", "x3065912 y z"
    rng = random.Random(5)
    rows = [f"{a} {b} {a}", f"{b} {a} {b}", f"{a} {b}", f"{a} {a} {b} {b}", " ".join(rng.choice("ab") for _ in range(300)), " ".join(rng.choice("abcdefghijk") for _ in range(20_000)), "a b", None]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")).collect()}
    assert got == {i: covered_words((t or "").split()) for i, t in enumerate(rows)}


def test_keep_good_columns_that_clash(spark):
    """Extra columns named as the operator's own come back unchanged; repeated rows and null ids stay as often as kept."""
    from tessera.llm.quality_rules import keep_good, quality_rules

    rng = random.Random(12)
    words = [f"{x}{y}" for x in "abcdefgh" for y in "uvwxyz"]
    text = " ".join(rng.choice(words) for _ in range(90))
    docs = spark.createDataFrame([(1, text, "en", False, "x", 3), (1, text, "en", False, "x", 3), (None, text, None, None, "y", 4), (2, "short", "en", True, None, 5)], "doc_id long, text string, lang string, kept boolean, n_words string, class_distance int")
    got = keep_good(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("kept is not true").collect()))
    assert quality_rules(docs).count() == 4 and keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [8 << 20, 1])
def test_quality_rules_references(spark, monkeypatch, sent):
    """Every language has its own reference, however small and however many there are; a null one has that of all rows."""
    from tessera.llm import quality_rules

    monkeypatch.setattr(quality_rules, "SENT_BYTES", sent)
    rng = random.Random(6)
    rows = [(t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts()) if len(t or "") < 5000]
    for k in range(70):
        own = [f"{chr(97 + k % 26)}{x}{k}" for x in ("a", "be", "ce", "d", "e")] + ["the", "of"]
        rows += [(" ".join(rng.choice(own).upper() if k % 3 == n else rng.choice(own) for _ in range(60)), f"l{k}") for n in range(2)]
    rows += [("once only words", "rare"), (" ".join(["x" * 40] * 3), "long"), (None, "none")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, (a, b, kept) in enumerate(brute_quality(rows)):
        assert abs(got[i]["class_distance"] - a) < 2e-6 and abs(got[i]["word_distance"] - b) < 2e-6, (i, rows[i], a, b, got[i])
        assert got[i]["kept"] == kept

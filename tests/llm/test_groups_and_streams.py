"""SuperMinHash near-duplicates, tokenizer alignment and fill-in-middle against brute force, and on odd rows."""

import collections
import functools
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SCHEMA, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dischargelab.llm import align, fim, minhash, queries

BYTE, PIECE = str(public_tokenizers.path(align.BYTE_BPE)), str(public_tokenizers.path(align.PIECE_BPE))
PATTERN = public_tokenizers.PATTERN


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# SuperMinHash

def brute_set(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_near(docs, percent=80):
    """(doc_id, n_shingles, component_id, kept) of every row, by all pairs."""
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), c, d == c) for i, (d, _) in enumerate(docs) for s in [sets[i]] for c in [names.get(find(i)) if s else d]), key=str)


def near_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"e{rng.integers(1 << 30)}"
    return words


@pytest.fixture(scope="module")
def families(spark):
    """Chains of edits, groups around one text, and texts that share half of their shingles with many others."""
    rng = np.random.default_rng(11)
    docs = []
    for f in range(12):
        base = [f"w{rng.integers(900)}" for _ in range(int(rng.integers(50, 200)))]
        for _ in range(15):
            docs.append(" ".join(edited(rng, base, max(1, len(base) // int(rng.integers(40, 150))))))
            base = edited(rng, base, int(rng.integers(0, 2)))
    common = [f"c{i}" for i in range(80)]
    docs += [" ".join(common + [f"own{k}x{i}" for i in range(28 + k % 9)]) for k in range(60)]
    docs += docs[:3] * 3 + ["Same Words here", "same words HERE", "", None]
    order = rng.permutation(len(docs))
    return spark.createDataFrame(rows([(int(i), docs[i]) for i in order]), SCHEMA).repartition(5)


@pytest.mark.parametrize("cell", [512, 4])
def test_near_groups_equal_all_pairs(families, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "HOT_COPIES", 3)
    got = near_of(minhash.near_groups(families))
    assert got == brute_near(texts_of(families))
    assert 12 < len({c for _, _, c, _ in got}) < len(got) - 50


def test_near_groups_of_weak_bands(families):
    """Two-row bands bring much more together that is no link; what is returned stays the same."""
    assert near_of(minhash.near_groups(families, bands=32, rows=2)) == brute_near(texts_of(families))


def test_near_groups_odd_rows(odd, none):
    assert near_of(minhash.near_groups(odd)) == brute_near(texts_of(odd))
    assert minhash.near_groups(none).count() == 0


def test_near_groups_without_ids(spark):
    docs = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "x y")]
    got = near_of(minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted([(None, 3, None, True), (None, 3, None, True), (None, 0, None, True), (3, 1, 3, True)], key=str)


def test_signatures_estimate_similarity_with_less_spread():
    rng = np.random.default_rng(1)
    m, shared, own = 128, 96, 16  # similarity 0.75, sets of about the signature's length
    found = []
    for _ in range(300):
        h = rng.integers(1 << 63, size=shared + 2 * own).astype(np.uint64)
        both = np.r_[h[: shared + own], h[:shared], h[shared + own:]]
        a, b = minhash.signatures(both, np.array([0, shared + own, 2 * (shared + own)]), m)
        assert (np.sort(a) == np.unique(a)).all()
        found.append((a == b).mean())
    assert abs(np.mean(found) - 0.75) < 0.01
    assert np.var(found) < 0.75 * 0.25 / m * 0.95  # independent hashes have the whole


def test_signatures_fill_all_registers_of_any_set():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = minhash.signatures(np.r_[h, h[:1], h[:3]], np.array([0, 1999, 2000, 2003]), 64)
    assert sig.max() < np.uint64(64) << np.uint64(32)
    assert sorted((sig[1] >> np.uint64(32)).tolist()) == list(range(64))  # one element visits every register once
    assert (sig[2] <= sig[1]).all() and (sig[2] < sig[1]).any()


# Alignment

@functools.cache
def libraries():
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PIECE), {v: k for k, v in _byte_characters().items()}


def brute_streams(text):
    tok, sp, byte_of = libraries()
    e = tok.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i))) for i in e.ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    return a, b


def _byte_characters():
    own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    return {b: chr(b) if b in own else chr(256 + [x for x in range(256) if x not in own].index(b)) for b in range(256)}


def brute_groups(text):
    """Groups (list of A ids, list of B ids), cut where both streams end a token."""
    if not text:
        return []
    a, b = brute_streams(text)
    if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
        return []
    cuts = set.intersection(*(set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)))
    out = []
    for side, s in enumerate((a, b)):
        at, group = 0, 0
        for i, x in s:
            at += len(x)
            while len(out) <= group:
                out.append(([], []))
            out[group][side].append(i)
            group += at in cuts
    return out


def brute_alignment(docs):
    groups = [(d, brute_groups(t)) for d, t in docs]
    n = collections.Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    best = collections.defaultdict(int)
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    out = []
    for d, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(n[x] == best[x[1]] for x in links),
                    sum(n[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def aligned(docs, limit=align.SENT_PAIRS):
    return sorted(map(tuple, align.link_statistics(align.align_documents(docs, BYTE, PATTERN, PIECE), limit).collect()), key=str)


STRANGE = ["  two  spaces", "▁ mark", "ﬁ ligature", "tab\there\r\nnew", "日本語 été naïve", "<s> </s> <unk> <0x41> <|endoftext|>",
           " ", "\n", "à combining", "\U0001f600 smile", "᠎ old space", "ⰯᲉ newer letters", "don't DON'T 12,345.6"]


def test_alignment_equals_brute_force(spark, odd, none):
    docs = odd.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(STRANGE, 100)), "doc_id long, text string"))
    want = brute_alignment(texts_of(docs))
    assert aligned(docs) == want
    assert aligned(docs, 10) == want  # rare pairs meet their counts in the join
    assert aligned(docs, 0) == want
    assert sum(r[3] for r in want) > 100
    assert aligned(none) == []


@pytest.mark.parametrize("text", STRANGE)
def test_byte_stream_equals_the_library(text):
    s = align.streams(BYTE, PATTERN, PIECE)[0]
    assert s.fast is not None
    assert s.encode(" " + text) == s.tokenizer.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.data())
def test_terminals(sizes, data):
    total, other = sum(sizes), []
    while sum(other) < total:
        other.append(data.draw(st.integers(1, total - sum(other))))
    a, b = np.cumsum(sizes), np.cumsum(other)
    cuts = np.intersect1d(a, b)
    root_a, root_b = align.terminals(a, b)
    assert (a[root_a] == cuts[np.searchsorted(cuts, a)]).all() and (a[root_b] == cuts[np.searchsorted(cuts, b)]).all()


def test_registered_alignment_of_whole_table(spark, small):
    want = brute_alignment(texts_of(spark.read.parquet(f"{small}/documents.parquet")))
    assert sorted(map(tuple, queries.QUERIES["op12_align"](spark, small).collect()), key=str) == want


# Fill-in-middle

def brute_fim(doc_id, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:i], u[i:j], u[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(u), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_odd_rows(spark, odd, none):
    marked = spark.createDataFrame([(70, "with <P> inside\nx"), (71, "a\n<M>"), (72, "<p>\r\n\n\né<S"), (73, "\n")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(marked)
    made = fim.fim_documents(docs)
    assert sorted(map(tuple, made.collect()), key=str) == sorted((brute_fim(*r) for r in texts_of(docs)), key=str)
    back = sorted(((r["doc_id"], r["restored"]) for r in fim.restore_documents(made).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in texts_of(docs)), key=str)
    assert fim.restore_documents(fim.fim_documents(none)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab\n\r é<P>SM")), max_size=30)), max_size=6), st.data())
def test_transform_and_restore(texts, data):
    draws = [pa.array([data.draw(st.integers(0, 2**32 - 1)) for _ in texts], pa.int64()) for _ in range(4)]
    cols = fim.transform(pa.array(texts, pa.string()).slice(0), draws, fim_percent=80)
    assert fim.restore(cols["output"], cols["form"]).to_pylist() == [t or "" for t in texts]
    assert cols["n"].to_pylist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t or "")) for t in texts]
    for t, form, p, m in zip(texts, *(cols[c].to_pylist() for c in ("form", "prefix_chars", "middle_chars")), strict=True):
        assert (form == "plain") == (p is None) == (m is None)
        assert p is None or p + m <= len(t)


def test_rounds_of_components_broadcast_nothing(spark):
    from dischargelab.llm import components as M

    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "u long, v long")
    plan = M._star(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert sorted(tuple(r) for r in M.components(pairs.toDF("a", "b")).collect()) == [(1, 1), (2, 1), (3, 1)]

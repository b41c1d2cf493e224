"""The operators against brute force on small fixtures with nulls, ties, copies, long texts and clashing columns."""

import base64
import gc
import hashlib
import math
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from pyspark.sql import functions as F

from veilscan.llm import bpe, chat, html_extract, licences, mixing, nearest, ngram_join, quality_classifier, quality_rules, secrets
from veilscan.llm.components import components
from veilscan.llm.queries import VOCABULARY, domains
from veilscan.llm.runtime import release
from veilscan.llm.sample_pages import pages

RANKS, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " \n\t ", "one", "a  b \n c", "é ü ß 漢字  x", "x" * 5000, "word " * 3000, "\\ <|im_end|> | <\\|", "a\r\nb", "tab\tend "]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, start)], "doc_id long, text string, lang string, source string, n_chars long")


def corpus(n=120, seed=3):
    """Prose with exact and near copies, a common passage and a big group of near copies."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    base = [r.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        k = i % 6
        words = [r.choice(vocab) for _ in range(r.randint(1, 80))]
        if k == 0 and out:
            words = (r.choice(out) or "x").split()
        elif k == 1 and out:
            words = (r.choice(out) or "x").split()
            words[r.randrange(len(words))] = "Changed"
        elif k == 2:
            words += passage.split()
        elif k in (3, 4):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocab)
        out.append(" ".join(words))
    return out + ODD_TEXTS


def brute_components(rows):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}, {(i, len(x)) for i in sets for x in sets[i]}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_jaccard_join(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # 3: nearly every list is dealt over blocks
    texts = corpus()
    rows = ngram_join.jaccard_components(docs(spark, texts)).collect()
    want, sizes = brute_components(list(enumerate(texts)))
    assert len(rows) == len(texts) and {r.doc_id: r.component_id for r in rows} == want
    assert {(r.doc_id, r.n_shingles) for r in rows} == sizes
    assert len(set(want.values())) < len(want) - 20


def test_jaccard_join_edges(spark):
    empty = docs(spark, [])
    assert ngram_join.jaccard_components(empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, None), (9, None), (7, "")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("n", F.lit(1)))
    assert sorted(map(tuple, got.where("doc_id is not null").collect())) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (9, 0, 9)] and got.count() == 6


def test_prefix_groups_with_several_sets(spark):
    """Groups whose members share a prefix but not a set are expanded: here every order is equal, so edits can fall outside prefixes."""
    r = random.Random(0)
    base = [f"v{i}" for i in range(100)]
    texts = []
    for _ in range(40):
        w = list(base)
        w[r.randrange(100)] = f"z{r.randrange(3)}"
        texts.append(" ".join(w))
    want, _ = brute_components(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs(spark, texts)).collect()} == want


@pytest.mark.parametrize("hot, lists", [(10_000, 1_000_000), (7, 1_000_000), (7, 0)])
def test_one_long_list_of_sets_of_many_sizes(spark, monkeypatch, hot, lists):
    """A passage in every document: one list holds sets of all sizes, few of which link; blocks, bands and the join without broadcast lose none."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BROADCAST_LISTS", lists)
    r = random.Random(1)
    passage = [f"p{i}" for i in range(9)]
    texts = []
    for i in range(90):
        own = [f"d{i}-{j}" for j in range(r.choice([0, 1, 2, 3, 20]))]
        texts.append(" ".join(passage * (i % 2) + own + ([f"q{j}" for j in range(r.randint(6, 60))] if i % 3 else [])))
    want, sizes = brute_components(list(enumerate(texts)))
    rows = ngram_join.jaccard_components(docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and {(r.doc_id, r.n_shingles) for r in rows} == sizes


def test_size_bands_never_part_sets_that_may_link():
    for percent in (80, 85, 100):
        width = ngram_join.JaccardJoin.__dict__["_band"](type("J", (), {"percent": percent})())
        for n in [*range(1, 3000), 10**6, 10**9]:
            most = 100 * n // percent  # the largest set that may link with one of n
            assert math.floor(math.log(most) / width) - math.floor(math.log(n) / width) <= 1


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_posting_lists_in_batches(size):
    """Batches of any size give the lists that a plain grouping gives."""
    r = random.Random(size)
    rows = sorted((t, 1 << 16, 100 * t + i, (r.randint(1, 40) << 32) + r.randint(0, 5)) for t in range(60) for i in range(r.choice([1, 1, 2, 2, 3, 5])))
    rows += [(99, (3 << 16) + s, 990 + s, 10 << 32) for s in range(3)]  # salted: one row a block
    link = lambda x, y: 100 * min(x >> 32, y >> 32) >= 80 * max(x >> 32, y >> 32) and 180 * (1 + min((x >> 32) - (x & 255) - 1, (y >> 32) - (y & 255) - 1)) >= 80 * ((x >> 32) + (y >> 32))
    by = defaultdict(list)
    for row in rows:
        by[row[:2]].append(row)
    want = []
    for group in by.values():
        if group[0][1] >> 16 > 1 or len(group) > 2 or (len(group) == 2 and link(group[0][3], group[1][3])):
            want += [(*x, *(y[2:] if y else (None, None))) for x, y in zip(group, [*group[1:], None])]
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])], names=["t", "blk", "gid", "np"]) for i in range(0, len(rows), size)]
    got = [tuple(x.values()) for b in ngram_join._lists(80)(iter(batches)) for x in b.to_pylist()]
    assert got == want


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (3, 50, 900):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)]))
        bits = sum(bin(int(a) & (2**64 - 1)).count("1") for a in ngram_join._parity(x) ^ ngram_join._parity(y))
        assert bits <= len(np.setxor1d(x, y))


def test_components(spark):
    chain = [(i + 1, i) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks", [(4096, 8192), (7, 23)])
def test_nearest(spark, monkeypatch, blocks):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:140] = v[50]  # one very common vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] + [1.0] * 15), (480, [float("inf")] * 16), (None, [1.0] * 16), (500, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    got = defaultdict(list)
    for r in nearest.nearest(frame, F.expr("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    w = v.astype(float)
    for q in range(0, 300, 20):
        s = (w * w[q]).sum(1)
        order = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:20]
        assert [(k, i) for k, i, _ in got[q]] == [(k + 1, i) for k, i in enumerate(order)]
        assert np.allclose([x for *_, x in got[q]], s[order], rtol=1e-13)
    assert set(got) == set(range(0, 300, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert nearest.nearest(few, F.expr("vec_id % 20 = 0")).count() == 2
    assert nearest.nearest(few.where("false"), F.expr("vec_id % 20 = 0")).count() == 0


def test_nearest_tile_with_repeated_ids():
    """Repeated ids count, as rows of their own, and a query's own id takes no neighbour's place."""
    rng = np.random.default_rng(2)
    v = rng.integers(-9, 9, (90, 8)).astype(np.float32)
    v[:30], v[30:40] = v[0], v[0] * 2
    ids = np.concatenate([np.zeros(35), np.arange(1, 56)]).astype(np.int64)
    ids[25:30] = 3
    q = np.flatnonzero(ids % 20 == 0)
    got = nearest.tile(ids[q], v[q], ids, v, 5)
    want = [(int(ids[i]), *x) for i in q for x in sorted(((int(c), float(v[i].astype(float) @ w)) for c, w in zip(ids, v) if c != ids[i]), key=lambda x: (-x[1], x[0]))[:5]]
    assert sorted(got) == sorted(want)


def _chat_want(turns):
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t, role is not None, role, text is not None, text))
    out = {}
    for c, rows in by.items():
        rows = sorted(rows, key=lambda r: tuple((x is not None, x) if not isinstance(x, bool) else x for x in r if x is not None))
        said = [(r[3] or "", r[5] or "") for r in rows]
        loss = "".join(t for role, t in said if role == "assistant")
        out[c] = (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_chat(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE_CHARS", piece)
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "\n", "", "é漢", "a\\nb", "<|image_0|>"]
    r = random.Random(2)
    turns = [(c, t, r.choice(["user", "assistant", "system", "odd\nrole", "<|x"]), r.choice(nasty) * r.randint(0, 3)) for c in range(20) for t in range(r.randint(1, 6))]
    turns += [(99, t, r.choice(["user", "assistant"]), f"{t} {r.choice(nasty)}") for t in range(500)]  # a third of all rows and more
    turns += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, None, "x")] + [(52, 1, "assistant", "tie")] * 3
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5).withColumn("part", F.lit("x")).withColumn("loss", F.lit(0))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.conversation_digests(frame).collect()}
    assert got == _chat_want(turns)
    assert chat.conversation_digests(frame.where("false")).count() == 0


def test_chat_parts():
    parts = chat.parse_parts('[{"type":"text","text":"see <|this|>"},{"type":"image","ref":"a.png","width":56,"height":30},{"type":"audio","ref":"b.wav","seconds":2},{"type":"document","ref":"c.pdf","pages":2}]')
    made = chat.format_turns([("user", parts), ("assistant", [chat.Text("ok")])])
    assert [(k, r, n) for k, r, _, n in made.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 512)]
    assert [made.text[p:].startswith(f"<|{k}_{i}|>") for i, (k, _, p, _) in enumerate(made.attachments)] == [True] * 3
    assert chat.read_turns(made.text)[0] == ("user", "see <|this|><|image_0|><|audio_1|><|document_2|>")
    assert [made.text[a:b] for a, b in made.loss] == ["ok"]
    with pytest.raises(KeyError):
        chat.parse_parts('[{"type":"video"}]')


def test_chat_frames_of_typed_parts(spark, monkeypatch):
    """The table operator flattens parts, with the loss and attachments at their places; repeated pieces read back whole."""
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    parts = '[{"type":"text","text":"see <|this|>"},{"type":"image","ref":"a.png","width":56,"height":30},{"type":"text","text":" and "},{"type":"document","ref":"c.pdf","pages":2}]'
    rows = [(c, 2 * t + k, ("user", "assistant")[k], f"said {c} {t}" if k else None, None if k else parts) for c in range(8) for t in range(3) for k in range(2)]
    frame = spark.createDataFrame(rows + [(None, 0, None, None, None)], "conv_id long, turn long, role string, text string, content string").withColumn("loss", F.lit(1))
    by = defaultdict(list)
    for r in sorted(chat.format_conversations(frame).collect(), key=lambda r: (r.part, r.seq)):
        by[r.conv_id].append(r)
    assert set(by) == {None, *range(8)}
    for c in range(8):
        text = "".join(r.formatted for r in by[c])
        turns = [(role, [chat.Text(t)] if t is not None else chat.parse_parts(p)) for i, _, role, t, p in rows if i == c]
        assert text == chat.format_turns(turns).text
        said = [r.formatted[x.start:x.end] for r in by[c] for x in r.loss]
        assert said == [f"said {c} {t}" for t in range(3)]
        found = [(x.kind, x.ref, x.tokens, r.formatted[x.place:].startswith(f"<|{x.kind}_")) for r in by[c] for x in r.attachments]
        assert found == [("image", "a.png", 4, True), ("document", "c.pdf", 512, True)] * 3
    with pytest.raises(Exception, match="video"):
        chat.format_conversations(spark.createDataFrame([(0, 0, "user", '[{"type":"video"}]')], "conv_id long, turn long, role string, content string")).collect()


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n=300):
    r = random.Random(5)
    pool = "abcdefgh  \n\t\r.,'s'll!?é漢字ß  😀0123<|>|"
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(n)] + [t or "" for t in ODD_TEXTS] + ["a" * 3000, " " * 400 + "x", "don't we'll I'm"]


def test_bpe_equals_the_library(encoder, library):
    for t in _texts():
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode_ordinary(t) and encoder.decode(ids) == t.encode()


def test_bpe_encodes_texts_together(library, monkeypatch):
    """Words that begin alike share the table of their common prefix; odd spaces, long words and empty texts mix with plain texts."""
    enc = bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
    texts = [*_texts(), " ".join("qxzv" * 8 + f"{c}" for c in "abcdefghij"), " x", "y ", "z" * 60 + " " + "z" * 60]
    read = []
    monkeypatch.setattr(bpe.PrefixTable, "append", lambda self, more, f=bpe.PrefixTable.append: read.append(more) or f(self, more))
    assert [x.tolist() for x in enc.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    # 4 in a word; the first word has no space before it, the nine others share theirs
    assert sum(more.count(b"qxzvqxzv") for more in read) == 8


def test_bpe_holds_little():
    """A worker keeps its encoder while other operators run: what that remembers is bounded well below the words it has seen."""
    enc = bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
    for part in range(40):
        enc.encode(" ".join(f"w{k * 7919 % 1000003:06d}x" for k in range(part * 10000, part * 10000 + 10000)))
    assert sum(len(v) for v in vars(enc).values() if isinstance(v, dict)) < 400_000


def test_bpe_appends_and_edits(encoder):
    data = "unbelievably extraordinary".encode()
    table = bpe.PrefixTable(encoder)
    for k in range(0, len(data), 3):
        table.append(data[k:k + 3])
    for end in range(len(data) + 1):
        assert table.ids(end) == encoder.merge(data[:end])
    r = random.Random(1)
    text = "the quick  brown fox\njumps over"
    whole = encoder.encoded(text)
    for _ in range(300):
        a = r.randint(0, len(text))
        b = r.randint(a, min(len(text), a + 6))
        new = r.choice(["", " ", "x", " new words ", "é", "\n", "  ", "a b", "\u3000"])
        text, whole = text[:a] + new + text[b:], encoder.edit(whole, a, b, new)
        assert whole.text == text and whole.ids == encoder.encode(text) and len(whole.ids) == sum(whole.counts)


def test_bpe_edits_encode_little(library, monkeypatch):
    """An edit of one character encodes the chunks around it, however long the text and its chunks are."""
    enc = bpe.BytePairEncoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
    text = " ".join(f"{'long' * 20}{i}" for i in range(300))
    whole = enc.encoded(text)
    made = []
    monkeypatch.setattr(bpe.BytePairEncoder, "piece", lambda self, t, f=bpe.BytePairEncoder.piece: made.append(t) or f(self, t))
    at = len(text) // 2
    after = enc.edit(whole, at, at + 1, "x")
    assert len(made) <= 16 and after.ids.tolist() == library.encode_ordinary(text[:at] + "x" + text[at + 1:])


def test_bpe_frames(spark, library):
    frame = docs(spark, ODD_TEXTS).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.tokenize(frame, RANKS, PATTERN, digest=True).collect()}
    for i, t in enumerate(ODD_TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.detokenize(bpe.tokenize(frame, RANKS, PATTERN), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(ODD_TEXTS)}
    assert bpe.tokenize(docs(spark, []), RANKS, PATTERN).count() == 0


def test_quality_rules(spark):
    texts = [*ODD_TEXTS, *corpus(30), "spam line here\n" * 40, " ".join(f"u{i}" for i in range(60)), "x y z " * 30, "x\nx\n x\n\n\nx", "a#*$%&|<>b", ("one two three four five six seven eight nine ten eleven " * 2 + " ".join(f"q{i}" for i in range(60)))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, texts).withColumn("kept", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
        if not failed:
            shares = []
            for n, most in quality_rules.COVERAGE.items():
                c = Counter(zip(*(w[k:] for k in range(n))))
                inside = {k + j for k, g in enumerate(zip(*(w[k:] for k in range(n)))) if c[g] > 1 for j in range(n)}
                shares.append(sum(len(w[k]) for k in inside) > most * sum(map(len, w)))
            lines, again = set(), 0
            for line in t.split("\n"):
                again += sum(map(len, WORD.findall(line))) if line in lines else 0
                lines |= {line} if WORD.search(line) else set()
            assert r.kept == (not any(shares) and again <= quality_rules.LINE_COVERAGE * sum(map(len, w)))
    assert got[len(texts) - 5].kept  # distinct words


BASE = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_secrets(spark):
    texts = [*ODD_TEXTS, "PassWord: 'abcdef' token=\"12345\" api-key=x secret = abc.def=", "é AKIA" + "A1" * 10 + " AKIAAKIA1", "f" * 24 + " " + "0f" * 20, "api_key:AKIA" + "B2" * 9, "paſſword=abcdefgh", "x passwd  =  ......", "toKen=abcdefgh",
             "see q7Xp2Lm9Zt4Rk8Vb1Nc6Wd3 here", "id 123e4567-e89b-12d3-a456-426614174000", "internationalization-of-everything2024", "sha " + "AB12" * 10, "n 12345678901234567890123"]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, texts).withColumn("spans", F.lit(1)), RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(BASE) for m in rx.finditer(t or "") if ok(m))
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t, got[i].spans, joined)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(f[1] == k for f in found) for k in range(3)]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]
    random_ones = {i for i, r in got.items() if "random" in r.spans}
    assert random_ones == {texts.index("see q7Xp2Lm9Zt4Rk8Vb1Nc6Wd3 here")}
    masked = {r.doc_id: r.text for r in secrets.scan(docs(spark, texts), RANKS, PATTERN, mask=True).collect()}
    assert masked[0] is None and masked[1] == "" and "AKIA" not in masked[texts.index("api_key:AKIA" + "B2" * 9)]
    assert masked[texts.index("see q7Xp2Lm9Zt4Rk8Vb1Nc6Wd3 here")] == "see [SECRET] here"


def test_random_runs_of_any_shape(encoder):
    """Random keys are found with or without digits; words, digests, UUIDs and numbers are spared."""
    r = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for pool, size in ((letters, 40), (letters, 64), (letters + "0123456789", 20), (letters + "0123456789+/", 24), (letters + "0123456789+/", 20)):
        keys = ["".join(r.choice(pool) for _ in range(size)) for _ in range(500)]
        assert sum(bool(secrets.random_spans(k, encoder)) for k in keys) >= 0.99 * len(keys), (len(pool), size)
    for spared in ("internationalization-of-everything2024", "src/main/java/org/example/service/UserController", "a-b-c-d-e-f-g-h-i-j-k-l", "x1_y2_z3_x4_y5_z6_x7_y8", "123e4567-e89b-12d3-a456-426614174000", "ab12" * 10, "2024-01-02-03-04-05-06-07"):
        assert not secrets.random_spans(spared, encoder), spared


def test_random_runs_beside_base_spans(encoder):
    """A run is masked whole unless base spans hold all of it."""
    key = "q7Xp2Lm9Zt4Rk8Vb1Nc6Wd3Yf5Hs0Jg7Tq2Kx9Bv"
    for text in (f"AKIA{'Q7ZX2M9K' * 2}/{key}", f"{key}-{'0f3a' * 6}"):
        assert secrets.masked(f"see {text} here", secrets.all_spans(f"see {text} here", encoder)[1]) == "see [SECRET] here"
    inside = f"password={key}"
    assert [k for _, k, _ in secrets.all_spans(inside, encoder)[1]] == [0]


def test_licence_gate_is_implied(spark):
    """Every line that ungated scoring confirms passes the gate, whatever of a template it holds."""
    words, r = set(licences.gate_words()), random.Random(8)
    lines = ["Available under CC BY 4.0.", "Released under the MIT terms.", "Photos shared under CC BY-NC 4.0", "This work is under a Creative Commons Attribution 4.0 International deed", "confidential and proprietary, copying of this file is strictly prohibited"]
    kept = [set(licences.grams(t)) for ts in licences.TEMPLATES.values() for t in ts]
    for t in [t for ts in licences.TEMPLATES.values() for t in ts]:
        for _ in range(40):
            w = t.split()
            for _ in range(r.randint(0, len(w) // 3)):
                del w[r.randrange(len(w))]
            lines.append(" ".join(w))
    held = [max(len(set(licences.grams(x)) & g) / len(g) for g in kept) for x in lines]
    assert all(h < licences.CONFIRM or words & set(licences.grams(x)) for x, h in zip(lines, held)) and all(h >= licences.CONFIRM for h in held[:5])
    model = licences.trained()
    got = {x.doc_id: x.family for x in licences.scan(docs(spark, lines)).collect()}
    for i, x in enumerate(lines):
        p = model.probabilities(x)
        f = model.families[int(p.argmax())]
        share = max((len(set(licences.grams(x)) & set(licences.grams(t))) / len(set(licences.grams(t))) for t in licences.TEMPLATES.get(f, [])), default=0)
        if abs(p.max() - licences.THRESHOLD) > 2e-3:
            assert got[i] == (f if p.max() >= licences.THRESHOLD and share >= licences.CONFIRM else None), x
    assert any(got[i] for i in range(5))


def test_html_held_out_and_odd_pages(spark):
    model = html_extract.trained()
    tests = pages(200, seed=77)
    got = html_extract.extract_all([h for h, _ in tests], model)
    hit = made = want = 0
    for g, (_, main) in zip(got, tests):
        a, b = Counter(x for x in g.split("\n\n") if x), Counter(x for x in main if x)
        hit, made, want = hit + sum((a & b).values()), made + sum(a.values()), want + sum(b.values())
    assert hit / made > 0.97 and hit / want > 0.97
    plain = '<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>A  title</h1><p><b>First&amp;\n one.<br>more<p>Two &lt;p&gt; words here, and more of them.</article><footer>&copy; x</footer>'
    odd = [None, "", "just text", "<p>", "<", "<div" * 3000, "<div>" * 3000 + "x", "</p></p>", plain, "<!-- <p>no</p> --><script>var t='<p>no</p>'</script>", '<p class="a>b', "x" * 100_000]
    rows = html_extract.extract(spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string").withColumn("text", F.lit(0)), model).collect()
    texts = {r.page_id: r.text for r in rows}
    assert texts[8] == "A title\n\nFirst& one. more\n\nTwo <p> words here, and more of them." and texts[0] == texts[1] == texts[3] == texts[9] == ""
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(odd)


def test_decoder_is_consistent():
    from veilscan.llm.dom import parse

    page = parse("<div><p>a</p><p>b</p></div><div>c</div>")
    n = len(page.tag)
    text = lambda keep: [page.texts[i] for i in keep]
    assert text(html_extract.decode(page, np.full(n, -1.0))) == []
    best = np.array([5.0 if page.texts.get(i) == "a" else -1.0 for i in range(n)])
    assert text(html_extract.decode(page, best)) == ["a"]  # its ancestors are kept with it
    up = np.array([3.0 if page.tag[i] != 0 else -1.0 for i in range(n)])
    assert set(text(html_extract.decode(page, up))) == {"a", "b", "c"}  # a kept container keeps a child


def test_quality_classifier_held_out(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality_classifier.train(d, labels)
    rows = quality_classifier.score(d, model).join(labels, "doc_id").where(quality_classifier.held_out()).collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.train(d, flipped)
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.labels, model.labels)  # held-out labels are not read


def test_quality_classifier_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD_TEXTS))] + [(None, 1, 0), (3, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, ODD_TEXTS).withColumn("score", F.lit("clash"))
    for model in (quality_classifier.train(frame, labels), quality_classifier.train(frame, labels.where("false")), quality_classifier.train(frame.where("false"), labels)):
        rows = quality_classifier.score(frame, model).collect()
        assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    raw, off = np.frombuffer(b"", np.uint8), np.zeros(3, np.int64)
    assert quality_classifier.features(raw, off).shape == (2, quality_classifier.SIZE)


def _mix_tables(spark, n=400):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        kind = r.choice(["clean", "clean", "clean", "junk", "toxic"])
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        if kind == "junk":
            w = [x + "***" for x in w]
        elif kind == "toxic":
            w[::4] = ["idiot"] * len(w[::4])
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic"), kind))
    return rows, labels


def test_mixing_meets_targets(spark):
    rows, labels = _mix_tables(spark)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("clash"))
    labelled = domains(spark.createDataFrame([x[:3] for x in labels[:200]], "doc_id long, quality int, toxic int"))
    for targets in ({"clean": 0.9, "junk": 0.05, "toxic": 0.05}, {"clean": 0.2, "junk": 0.4, "toxic": 0.4}):
        out, report = mixing.mix(frame, labelled, targets)
        got = out.collect()
        assert len(got) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
        total = sum(r.tokens for r in got)
        for k, d in enumerate(targets):
            assert abs(sum(r.rate * r.tokens * r.posterior[k] for r in got) / total - targets[d]) < 1e-5
        kinds = {x[0]: x[3] for x in labels}
        assert np.mean([r.posterior[list(targets).index(kinds[r.doc_id])] > 0.5 for r in got if r.doc_id >= 200]) > 0.95
    assert report["steps"] <= mixing.STEPS


def test_mixing_samples_documents_that_exist(spark):
    """Labels of absent documents take no place in the sample."""
    rows, labels = _mix_tables(spark, 120)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = domains(spark.createDataFrame([x[:3] for x in labels] + [(i, 1, 0) for i in range(1000, 6000)], "doc_id long, quality int, toxic int"))
    alone = domains(spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int"))
    names = ["clean", "junk", "toxic"]
    assert mixing.fit_domains(frame, labelled, names, 100) == mixing.fit_domains(frame, alone, names, 100)


def test_mixing_scores_a_stem_once(spark):
    """Words with one stem count once, without a second pass over the stems."""
    scored = mixing.DomainModel(["a", "b"], [0.0, 0.0], {"x": [1.0, 0.0]}, {}).posteriors(docs(spark, ["x, x. X! y"]))
    assert abs(scored.first().posterior[0] - 1 / (1 + np.exp(-1))) < 1e-12
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1


def test_mixing_edges(spark):
    labelled = domains(spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    targets = {"clean": 0.5, "junk": 0.5, "toxic": 0.0}
    for texts in ([], ODD_TEXTS, [None, None]):
        for lab in (labelled, labelled.where("false")):
            out, _ = mixing.mix(docs(spark, texts), lab, targets)
            got = out.collect()
            assert len(got) == len(texts) and all(r.rate >= 0 and r.copies >= 0 for r in got)
    twice, _ = mixing.mix(docs(spark, ["a b c"]).union(docs(spark, ["a b c"])), labelled, targets)
    a, b = twice.collect()
    assert a == b


def test_mixing_words(spark):
    """Tokens are the words between white space; markers match in any case, before punctuation and at line ends."""
    texts = [*ODD_TEXTS, "a\nb\nc", "a\tb\x0bc\x0cd\re", "one\n" * 50, "  x   y "]
    got = {r.doc_id: r.tokens for r in mixing._featured(docs(spark, texts)).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    forms = ["idiot.", "Idiot", "(IDIOT)", "x\nidiot\ny", "idiot$$$", "\u201cidiot\u201d,", "idiots"]
    model = mixing.DomainModel(["a", "b"], [0.0, 0.0], {"idiot": [0.0, 3.0]}, {})
    assert all(r.posterior[1] > 0.9 for r in model.posteriors(docs(spark, forms)).collect())
    assert all(r.posterior[1] == 0.5 for r in model.posteriors(docs(spark, ["no such word", "anidiot"])).collect())
    shapes = mixing._featured(docs(spark, ["ABab12\u00e9\u00e9", "ab"])).orderBy("doc_id").collect()
    assert {"upper 6", "digits 6"} <= set(shapes[0].shapes) and {"upper 0", "digits 0"} <= set(shapes[1].shapes)


def test_licences(spark):
    model = licences.trained()
    lines = [t for ts in licences.TEMPLATES.values() for t in ts]
    want = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    texts = ["Intro text.\n" + t.capitalize() + ".\nmore words" for t in lines] + list(licences.LOOKALIKES) + [None, "", "\n\n", "x " * 3000, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."]
    rows = {r.doc_id: r for r in licences.scan(docs(spark, texts).withColumn("family", F.lit(1))).collect()}
    assert np.mean([rows[i].families == f for i, f in enumerate(want)]) > 0.95
    assert np.mean([rows[i].n_licence == 0 for i in range(len(lines), len(lines) + len(licences.LOOKALIKES))]) > 0.95
    assert rows[len(texts) - 1].families == "cc-by-nc,mit" and rows[len(texts) - 1].n_licence == 2
    assert all((rows[i].n_licence, rows[i].families, rows[i].family) == (0, "", None) for i in range(len(texts) - 5, len(texts) - 1))
    for i, line in enumerate(lines):  # the frame's probabilities are the model's
        for p in rows[i].licence_paragraphs:
            assert p.line == 1 and abs(p.probability - model.probabilities(line).max()) < 2e-3
    assert [rows[i].n_paragraphs for i in range(len(texts) - 5, len(texts))] == [0, 0, 0, 1, 2]
    assert licences.scan(docs(spark, [])).count() == 0


def test_licences_held_out(spark):
    """Statements that no template or frame gives: the families named, and silence on licences that none knows."""
    told = [
        ("gpl", "SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("mpl", "// SPDX-License-Identifier: MPL-2.0"), ("epl", "SPDX-License-Identifier: EPL-2.0"), ("bsd", "# SPDX-License-Identifier: BSD-2-Clause"),
        ("unlicense", "SPDX-License-Identifier: Unlicense"), ("agpl", "SPDX-License-Identifier: AGPL-3.0"), ("boost", "Boost Software License, Version 1.0"), ("cc-by-nd", "Licensed under CC BY-ND 4.0."), ("gpl", "All our tools are GPLv3 software."),
        ("mit", "Ver\u00f6ffentlicht unter der MIT-Lizenz."), ("bsd", "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met"),
        ("mit", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles"), ("apache", "This library comes with the Apache License, Version 2.0, like its parent"), ("mit", "You can use it under the MIT license, as always"),
        ("gpl", "Copyright 2011 Jane; you get it under the GNU General Public License, either version 2 or any later one"), ("cc0", "Data: CC0 1.0 Universal, no attribution needed"), ("cc-by-sa", "Maps and photos are CC BY-SA 4.0"), ("proprietary", "(c) 2019 Example Corp. All rights reserved."), ("isc", "The parser is under the ISC license"),
        (None, "Licensed under the Sleepycat License"), (None, "Released under the Ruby License"), (None, "Licensed under the Open Font License, version 1.1"), (None, "The Microsoft Public License applies"), (None, "CeCILL-2.1"), (None, "Your driving license, version 2, expires in May"),
        (None, "the library is free for all, by law"), (None, "She got permission to copy the file at no charge"), (None, "mit der Lizenz zum Fahren"), (None, "The public was met by the company at the source of the river"),
    ]
    got = {r.doc_id: r for r in licences.scan(docs(spark, [t for _, t in told])).collect()}
    confusion = Counter((f, got[i].family) for i, (f, _) in enumerate(told))
    assert sum(n for (f, g), n in confusion.items() if f == g) >= len(told) - 2, confusion
    assert not any(g for (f, g), n in confusion.items() if f is None) and not any(f and g and f != g for f, g in confusion), confusion
    assert all(got[i].n_licence <= 1 for i in range(len(told)))


def test_licences_with_clashing_names_and_odd_lines(spark):
    text = "Released under the MIT License."
    names = ["lines", "marked", "made", "best", "suspects", "_row", "families", "a.b"]
    frame = docs(spark, [f"one\rtwo\u2028{text}\n\n x", None, text]).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    rows = licences.scan(frame).orderBy("doc_id").collect()
    assert all(r[n] == f"own {n}" for r in rows for n in names if n != "families") and [r.families for r in rows] == ["mit", "", "mit"]
    assert [r.n_paragraphs for r in rows] == [2, 0, 1] and rows[0].licence_paragraphs[0].line == 0
    twice = frame.union(frame)
    assert Counter(map(str, licences.scan(twice).collect())) == {str(r): 2 for r in rows}


def test_mixing_keeps_clashing_names(spark):
    rows, labels = _mix_tables(spark, 60)
    names = ["t", "h", "w", "pieces", "shapes", "found", "by_word", "logits", "odds", "_row", "x.y"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    labelled = domains(spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int"))
    out, report = mixing.mix(frame, labelled, {"clean": 0.9, "junk": 0.05, "toxic": 0.05})
    got = out.collect()
    assert out.columns == [*frame.columns, "tokens", "posterior", "rate", "copies"] and all(r[n] == f"own {n}" for r in got for n in names) and report["met"]
    same = mixing.mixture(frame.withColumn("rate", F.lit("mine")), labelled, {"clean": 0.9, "junk": 0.05, "toxic": 0.05})
    assert same.columns == [*frame.columns, "rate"] and Counter(r.doc_id for r in same.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert {r.rate for r in same.collect()} == {"mine"}


def test_mixing_says_when_targets_cannot_be_met(spark):
    rows = [(i, "one clean text here") for i in range(20)]
    labelled = domains(spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    with pytest.warns(UserWarning, match="not met"):
        _, report = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labelled, {"clean": 0.1, "junk": 0.1, "toxic": 0.8})
    assert not report["met"]


def test_mixing_equals_brute_force(spark):
    """Posteriors by plain Python, and rates no further from the targets than a generic nonnegative solver's."""
    rows, labels = _mix_tables(spark, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["clean", "junk", "toxic"]
    labelled = domains(spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int"))
    targets = {"clean": 0.5, "junk": 0.2, "toxic": 0.3}
    model = mixing.fit_domains(frame, labelled, names)
    shapes = {r.doc_id: r.shapes for r in mixing._featured(frame).collect()}
    out, _ = mixing.mix(frame, labelled, targets)
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        stems = {w.strip(mixing.PUNCTUATION)[:mixing.STEM] for w in text.lower().split()}
        z = np.array(model.prior) + sum((np.array(model.words[s]) for s in stems if s in model.words), np.zeros(3)) + sum((np.array(model.shapes[s]) for s in shapes[i] if s in model.shapes), np.zeros(3))
        e = np.exp(z - z.max())
        assert np.allclose(got[i].posterior, e / e.sum()) and got[i].tokens == len(text.split())
    a = np.array([[got[i].tokens * p for p in got[i].posterior] for i, _ in rows]).T
    want = np.array(list(targets.values())) * sum(r.tokens for r in got.values())
    x = np.ones(len(rows))
    for _ in range(20000):  # plain projected gradient
        x = np.maximum(0, x - a.T @ (a @ x - want) / np.linalg.norm(a, 2) ** 2)
    rates = np.array([got[i].rate for i, _ in rows])
    assert (rates >= 0).all() and np.linalg.norm(a @ rates - want) <= np.linalg.norm(a @ x - want) + 1e-4 * want.sum()


def test_quality_classifier_sample_is_bounded(spark):
    """One id with many texts and rows takes no more of the sample than any other rows would."""
    frame = spark.createDataFrame([(1, f"text number {i} with words") for i in range(400)] + [(1, "same")] * 100 + [(3, "other words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    labels = labels.where(~quality_classifier.held_out())
    assert labels.count() > 0
    assert len(quality_classifier.train(frame, labels, sample=2).vectors) <= 2
    assert len(quality_classifier.train(frame, labels, sample=10_000).vectors) <= 402


def test_quality_classifier_equals_brute_force(spark):
    """Scores are votes of the exact nearest labelled vectors, found one by one."""
    texts = [*corpus(60), *(t.upper() + " ***" for t in corpus(40, seed=9)[:40])]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 70), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(frame, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(frame, model).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        v = (quality_classifier.features(raw, np.array([0, len(raw)])) @ model.weights)[0]
        v = v / max(np.linalg.norm(v), 1e-12)
        near = sorted(((float(v @ w), y) for w, y in zip(model.vectors, model.labels)), reverse=True)[:quality_classifier.NEIGHBOURS]
        votes = [(max(s, 0) ** quality_classifier.SHARPNESS, y) for s, y in near]
        want = (sum(s * y for s, y in votes) + 0.01 * model.prior) / (sum(s for s, _ in votes) + 0.01)
        assert abs(got[i] - want) < 2e-3, (i, got[i], want)


def test_nearest_with_huge_and_tiny_components(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[:5] *= 1e200
    v[5:9] *= 1e-200
    v[9] = [1e308, -1e308, 1e308, 1e308]
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(frame, F.expr("vec_id % 5 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 60, 5):
        with np.errstate(all="ignore"):
            s = [sum((a * b for a, b in zip(v[q], w)), 0.0) for w in v]
        order = sorted((k for k in range(60) if k != q), key=lambda k: (s[k] == s[k], -s[k] if s[k] == s[k] else 0, k))[:7]
        assert got[q] == order, q


def test_html_judged_by_hand(spark):
    """Pages written by hand, with the text that a reader would call the article."""
    wrap = lambda body: f"<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A headline about rivers</h1>{body}</article><footer><p>&copy; 2020 Example Site</p></footer></body></html>"
    one, two = "The river rose by two metres in one night, and the town was warned in time.", "Nobody was hurt, but the old bridge has to be built again next year."
    head = "A headline about rivers"
    pages_ = [
        (wrap(f'<p title="a < b">{one}</p><p>{two}</p>'), [head, one, two]),
        (wrap(f'<p data-x="<b>x</b> > y">{one}</p><p>{two}</p>'), [head, one, two]),
        (wrap(f"<p>{one} <audio controls>{two}</p><p>{one}</p>"), [head, f"{one} {two}", one]),
        (wrap(f"<p>{one}<svg><text>icon</text></svg></p><p>{two}<iframe src=x></p><p>{one}</p>"), [head, one, two, one]),
        (wrap(f"<p>{one} So <math><mi>h</mi><mo>=</mo><mn>2</mn></math> metres.</p><p>{two}</p>"), [head, f"{one} So h=2 metres.", two]),
        (wrap(f"<p>{one} <object>{two}</object></p><noscript><p>{two}</p></noscript><p>{one}</p>"), [head, f"{one} {two}", two, one]),
        (wrap(f"<p>{one}</p><!-- {two} --><script>var x = '<p>{two}</p>';</script><style>p{{}}</style><p>{two}</p>"), [head, one, two]),
        (wrap(f"<p>{one}<br>\n  {two}</p><p>caf&eacute; &amp; &#x41; &lt;b&gt; and then some more words follow.</p>"), [head, f"{one} {two}", "caf\u00e9 & A <b> and then some more words follow."]),
        (wrap("<p>x" + "<button>" * 20 + "Press" + "</button>" * 20 + f" {one}</p><p>{two}</p>"), [head, f"x {one}", two]),
        (wrap(f"<p class=it's>{one} It's <a href=it's>don't</a> there.</p><p>{two}</p>"), [head, f"{one} It's don't there.", two]),
    ]
    got = html_extract.extract(spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages_)], "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert [texts[i] for i in range(len(pages_))] == ["\n\n".join(want) for _, want in pages_]


def test_secret_spans_sweep_once(encoder):
    """Base spans are looked at once, however many runs there are."""
    text = " ".join(f"password=abcdef{i} q7Xp2Lm9Zt4Rk8Vb1Nc6Wd{i}" for i in range(400))
    base = secrets.base_spans(text)
    looked = []

    class Watched(list):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    left = secrets._uncovered(secrets.random_spans(text, encoder), Watched(base))
    assert len(left) >= 390 and len(looked) <= 4 * len(base) + 4 * len(left)
    assert secrets._uncovered([(10, 3, 40)], [(0, 0, 25), (20, 1, 41)]) == [] and secrets._uncovered([(10, 3, 40)], [(0, 0, 25), (26, 1, 41)]) == [(10, 3, 40)]


@pytest.mark.parametrize("rows", [[], [(1, "one two three"), (1, "one two three"), (None, None)]])
def test_repeated_rows_and_empty_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    for made in (quality_rules.quality_rules(frame.drop("spans")), secrets.scan(frame, RANKS, PATTERN), bpe.tokenize(frame, RANKS, PATTERN), licences.scan(frame), html_extract.extract(frame.selectExpr("doc_id page_id", "'u' url", "text html"), html_extract.trained())):
        got = Counter(map(str, made.collect()))
        assert sum(got.values()) == len(rows) and sorted(got.values()) == ([1, 2] if rows else [])


def test_arrow_slices():
    from veilscan.llm.textbatch import column_bytes, shingle_sets, slices

    col = pa.array(["skip", None, "A b C d e F", "", "a b c d e f", "one two"]).slice(1)
    raw, off = column_bytes(col)
    for most in (1, 8, 1000):
        sets = [s for i, j in slices(off, most) for s in shingle_sets(raw[off[i]:off[j]], off[i:j + 1] - off[i])]
        assert [len(s) for s in sets] == [0, 2, 0, 2, 1] and sets[1].tolist() == sets[3].tolist()


def test_release_returns_native_memory(spark):
    """Free blocks between used ones stay resident until the allocators of the driver's two processes are told to give them back."""
    held = lambda pid: sum(int(x.split()[1]) for x in open(f"/proc/{pid}/smaps_rollup") if x.startswith("Anonymous:")) / 1024
    jvm = spark.sparkContext._jvm
    java = jvm.java.lang.ProcessHandle.current().pid()
    buffers, some = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    blocks = [b"x" * 60_000 for _ in range(2000)]
    for i in range(2000):
        buffers.add(jvm.java.nio.ByteBuffer.allocateDirect(60_000))
        if i % 50 == 0:
            some.add(buffers.get(i))
    del buffers
    blocks = blocks[::50]
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = held(java), held(os.getpid())
    release(spark)
    after = held(java), held(os.getpid())
    assert before[0] - after[0] > 60 and before[1] - after[1] > 60 and some.size() == len(blocks)

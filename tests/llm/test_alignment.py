"""Token alignment against whole texts, pair by pair."""

import base64
import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shardwise.llm import token_align
from shardwise.llm.common import table

from ..conftest import TESTDATA
from .helpers import docs_frame

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def within(spans, start, end):
    return spans[bisect.bisect_left(spans, (start,)):bisect.bisect_left(spans, (end,))]


def brute(rows):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    bytes_a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def token_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(map(token_b, ids_b)) != whole:
            docs.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        spans_a, spans_b = [], []
        for ids, spans, token in ((ids_a, spans_a, bytes_a.get), (ids_b, spans_b, token_b)):
            at = 0
            for i in ids:
                spans.append((at, at + len(token(i)), i))
                at = spans[-1][1]
        ends = sorted({s[1] for s in spans_a} & {s[1] for s in spans_b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for _, _, i in within(spans, start, end))
                                   for spans in (spans_a, spans_b)))
            start = end
        links = Counter((x, y) for s, e, x in spans_a
                        for t, f, y in spans_b[max(0, bisect.bisect(spans_b, (s,)) - 1):bisect.bisect(spans_b, (e,))]
                        if max(s, t) < min(e, f))
        docs.append((doc_id, len(ids_a), len(ids_b), len(groups), links,
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(pair for d in docs for pair in d[4])
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((d, na, nb, g, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in links.items()), sha) for d, na, nb, g, links, sha in docs),
                  key=repr)


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " ", "  ", "\n", "a", " lead", "trail ", "two  spaces", "tab\tand \t mixed", "line\nline\n\nend\n",
           "don't it's we'll", "<|endoftext|> <s> </s> <unk>", "▁mark", "has ▁ mark", "café naïve",
           "你好 世界", "\U0001f600 smile", "no break", " em   em", "\x00nul \x1c fs",
           "a" * 3000, " " * 500, "1234567890 3.14159", "word " * 300, "!!! ??? ...", "x\r\ny", "ภาษ"]
    alphabet = " " * 5 + "\n\t ▁abcdeABC123.,!'é你\U0001f600́​"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return out


@pytest.mark.parametrize("frequent", [1 << 17, 8, 0])
def test_alignment_of_odd_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(token_align, "FREQUENT", frequent)
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a repeated id"), (None, "no id at all"), (3, "a repeated id")]
    df = docs_frame(spark, rows).selectExpr("*", "1 as row", "2 as n_a", "'x' as pairs")
    out = token_align.align(df)
    assert tuple(out.columns) == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def test_remembered_parts_are_bounded(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(odd_texts())]
    v = token_align.vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    parts = token_align.Parts(v)
    whole = token_align.align_block([i for i, _ in texts], [t for _, t in texts], parts)
    monkeypatch.setattr(token_align, "REMEMBERED", 5)
    for i, t in texts:
        alone = token_align.align_block([i], [t], parts)
        assert len(parts.strings) <= 5
        assert alone.to_pylist() == whole.slice(i, 1).to_pylist()


def test_identity_map_has_the_same_bytes():
    v = token_align.vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert v.cuts
    for a in range(v.n_a):
        if v.same[a] >= 0:
            b = v.same[a]
            assert (v.flat_a[v.starts_a[a]:v.starts_a[a + 1]].tobytes()
                    == v.flat_b[v.starts_b[b]:v.starts_b[b + 1]].tobytes())
    assert (v.same >= 0).sum() > 5000


def test_given_documents_and_empty_table(spark):
    docs = table(spark, f"{TESTDATA}/sf0.001", "documents")
    got = sorted((tuple(r) for r in token_align.align(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert token_align.align(docs.limit(0)).count() == 0

import random
import struct

from tokenizers import Tokenizer

from tallyforge.llm import bpe
from tallyforge.llm.token_counts import fitting, token_counts, vocabulary


def test_prefix_counts_equal_the_library():
    path = vocabulary()
    coder, library = bpe.load(path), Tokenizer.from_file(path)
    r = random.Random(1)
    cases = ["", " ", "a  b", "a \n b ", "don't 're'll x'r", "<|endoftext|>x<|endoftext|> y", "<|endo", "日本語 ñandú 🙂🙂  é", "'s've", "a" * 200, " " * 70 + "x", "x'llama", "a b.\nCd e\nf", "a b\n c", "a b\n\nc d", "a \nb", "a b\n's c", "a b\n1x!\ny z", "a b\t\nc d"]
    cases += ["".join(r.choice("ab '\n\t<|>endoftx1é.sr l v ") for _ in range(r.randint(1, 40))) for _ in range(400)]
    for s in cases:
        ids = library.encode(s, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", coder.ids(s))) == ids
        want = [len(library.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert coder.prefix_counts(s) == want and coder.total(s) == len(ids) and bpe.counts(coder.steps(s)).tolist() == want
        assert coder.fit(s, 5) == max(i for i, n in enumerate(want) if n <= 5)


def test_operator(docs, texts):
    library = Tokenizer.from_file(vocabulary())
    counted = token_counts(docs, 100)
    rows = counted.collect()
    for r in rows:
        text, table = texts[r.doc_id][0], bpe.counts(r.prefix_steps)
        assert len(table) == len(text) + 1 and table[-1] == r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert table[r.fit_chars] <= 100 and (table[r.fit_chars + 1 :] > 100).all()
    assert any(r.over_limit for r in rows) and not all(r.over_limit for r in rows)
    # any other budget is answered from the stored tables
    for budget in (0, 7, 10**9):
        want = {r.doc_id: max(i for i, n in enumerate(bpe.counts(r.prefix_steps)) if n <= budget) for r in rows}
        assert {r.doc_id: r.fit_chars for r in fitting(counted, budget).collect()} == want


def test_words_that_come_late(monkeypatch):
    path = vocabulary()
    monkeypatch.setattr(bpe, "FIRST", 3)
    monkeypatch.setattr(bpe, "LATER", 2)
    monkeypatch.setattr(bpe, "HEADS", 2)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    coder, library = bpe.Bpe(path), Tokenizer.from_file(path)
    r = random.Random(3)
    for _ in range(200):
        s = " ".join("".join(r.choice("abcdeé.") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 30)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", coder.ids(s))) == ids and coder.total(s) == len(ids) == bpe.counts(coder.steps(s))[-1]
    assert len(coder.words) <= 3 and len(coder.words.later) <= 2 and len(coder.known) <= 2 and len(coder.pairs) <= 5

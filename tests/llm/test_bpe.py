import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import docs_dir, frame
from vexel.llm import bpe
from vexel.llm.queries import op5_bpe

ODD = ["", None, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 50_000, " " * 3000, "\n" * 500 + "x", "naïve 中文 🙂 can't I'LL", "\u0085\x1c\x0b\xa0 x", "same", "same"]


def test_matches_the_library(spark, tmp_path):
    r = random.Random(3)
    texts = ODD + ["".join(r.choices(list(" \n\tabcdeABé中9'") + ["the ", "ing", "<|endoftext|>"], k=r.randint(0, 80))) for _ in range(300)]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {x.doc_id: x for x in op5_bpe(spark, docs_dir(spark, tmp_path, frame(spark, texts))).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert out[i].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False).encode())


def test_every_code_point_is_cut_as_the_library_does():
    lib, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.tokenizer()
    texts = ["".join(f"a{chr(c)}b {chr(c)}9" for c in range(s, s + 256)) for s in range(0, 0x20000, 256) if not 0xD800 <= s < 0xE000]
    for x, y in zip(own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(x, "<u4").tolist() == y.ids


def test_pair_rule_is_the_merge_rule():
    own, r = bpe.tokenizer(), random.Random(7)
    toks = list(own.size)
    for _ in range(3000):
        a, b = r.choice(toks), r.choice(toks)
        x, y = own.bytes_of[a], own.bytes_of[b]
        if own.merge(x) == [x] and own.merge(y) == [y]:
            assert own._apart(a, b) == (own.merge(x + y) == [x, y])


def test_prefixes_are_shared_between_batches_and_the_trie_may_start_anew(monkeypatch):
    lib, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(11)
    texts = [" ".join("".join(r.choices("abeinrst\u00e9", k=r.randint(1, 9))) for _ in range(30)) for _ in range(60)]
    own = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    own.encode_batch(["international"])
    nodes = len(own.last)
    own.encode_batch(["internationally interning"])
    assert len(own.last) - nodes == len("ly") + len(" interning")  # a shared prefix makes no nodes
    for most in (bpe.TRIE_NODES, 40):
        monkeypatch.setattr(bpe, "TRIE_NODES", most)
        own.known.clear()
        for t in texts:
            assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert most > 40 or len(own.last) < 100


def test_null_ids_and_repeats_keep_their_rows(spark):
    out = bpe.encode(frame(spark, ["a b", "a b", None], ids=[None, 4, 4])).collect()
    assert sorted((str(x.id), x.n_tokens) for x in out) == [("4", 0), ("4", 2), ("None", 2)]


def test_round_trip_and_empty(spark):
    df = frame(spark, ["héllo  wörld\n", "x", None])
    assert sorted(x.text for x in bpe.decode(bpe.encode(df)).collect()) == ["", "héllo  wörld\n", "x"]
    assert bpe.encode(frame(spark, [])).count() == 0

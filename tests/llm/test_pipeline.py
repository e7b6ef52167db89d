import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import SCHEMA, frame
from vexel.llm import decontam, secrets

WORDS = {"xx": ["korel", "vaska", "mindo", "paruta", "selk", "drovi", "tamel"], "yy": ["thring", "owth", "eagh", "shrew", "whyte", "blorth", "knigh"]}


def jaccard(a, b):
    s = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(1)
    say = lambda lang, n: " ".join(r.choice(WORDS[lang]) + r.choice(["", "a", "en", "ir", "os", "umi", "ek"]) for _ in range(n))
    langs = [r.choice(["xx", "yy"]) for _ in range(60)]
    texts = [say(x, 300) for x in langs]
    item = say("xx", 30)
    texts[50] += " " + item.upper()
    texts[51] += " password = 'hunter2222' end"
    near = texts[3].split()
    near[20] = "different"
    texts += [" ".join(near), texts[5], "12345 !!", "", None, "Привет как дела это другой язык"]
    langs += ["xx", "xx", "xx", "xx", None, None]
    df = frame(spark, texts, langs=langs)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [i for i in range(60)]
    assert all(jaccard(texts[i], texts[j]) < 0.5 for i in range(60) for j in range(i)) and jaccard(texts[60], texts[3]) > 0.8
    kept = [i for i in kept if decontam.normalise(item) not in decontam.normalise(texts[i])]
    assert len(kept) == 59 and sorted(out) == kept
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in kept:
        t = texts[i].replace("password = 'hunter2222", "[SECRET]") if i == 51 else texts[i]
        assert np.frombuffer(out[i].ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == frame(spark, []).schema.simpleString() and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
    assert secrets.RULES and SCHEMA

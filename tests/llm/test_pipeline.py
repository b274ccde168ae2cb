import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from staycheck.llm import bpe
from staycheck.llm.queries import BPE_FILE
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_components, brute_print


def fixture():
    rng = random.Random(4)
    syllables = {"en": ["the", "and", "ing", "tion", "er"], "de": ["der", "und", "sch", "ung", "keit"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    items = [(n, text("en", 25)) for n in range(3)]
    docs = []
    for i in range(40):
        lang = "en" if i % 3 else "de"
        docs.append((i, text(lang, rng.randint(30, 90)), lang))
    docs += [(100 + i, docs[i % 5][1].upper(), "en") for i in range(12)]  # exact copies but for case
    docs += [(200 + i, docs[6][1] + f" w{i}", "de") for i in range(4)]  # some of them near copies
    docs += [(300 + i, f"{text('en', 9)} {items[i][1].upper()}", "en") for i in range(2)]
    docs += [(400, None, None), (401, "12 !!", "en"), (402, "", "de")]
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t, _ in docs if t and any(c.isalpha() for c in t)}
    last = {t.lower(): i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t.lower()] == i}
    found = brute_components([(i, brute_print(t)) for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if found[i] == i}
    bad = {i for i, _ in leaks(list(kept.items()), items)}
    assert {300, 301} <= bad
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path(BPE_FILE)))
    want = {}
    for i, t in kept.items():
        if i not in bad:
            ids = library.encode_ordinary(t)
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    stage = frame
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, str(tmp_path))
        assert stage.schema == frame.schema, name

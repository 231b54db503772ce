"""Figures behind single operators: altered license texts, ablation counts, noisy-or by loops, the bound of the fitting sample."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from siteatlas.llm import licenses, quality_ledger, toxicity
from siteatlas.llm.common import prepare, table

SMALL = "/root/testdata/sf0.001"


def words_of(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(licenses._words(F.col("text")).alias("w")).first()
    return row["w"]


def test_altered_long_templates_are_found(spark):
    """Long templates, shifted and with up to three words replaced where 0.8 of the shingles stay; unlike texts are not matched."""
    prepare(spark)
    rng = random.Random(7)
    junk = lambda n: [f"zq{rng.randrange(10**6)}" for _ in range(n)]
    docs, want, of, doc = [], {}, {}, 0
    for number, (_, text) in enumerate(licenses.TEMPLATES):
        words = words_of(spark, text)
        shingles = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        if len(shingles) < licenses.LONG:
            continue
        for _ in range(25):
            new = list(words)
            for at in rng.sample(range(len(new)), rng.randrange(4)):
                new[at] = junk(1)[0]
            left = {tuple(new[i:i + 5]) for i in range(len(new) - 4)}
            docs.append((doc, " ".join(junk(rng.randrange(9)) + new + junk(5))))
            of[doc] = number
            if len(shingles & left) >= 0.8 * len(shingles):
                want[doc] = number
            doc += 1
    docs += [(doc + i, " ".join(junk(80))) for i in range(20)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id: {m.template for m in r.matches} for r in got}
    assert len(want) >= 60
    assert all(number in found[d] for d, number in want.items())
    assert not any(found[d] for d, _ in docs[-20:])
    assert not any(of[d] in found[d] for d in of if d not in want)


def test_ablation_equals_brute_force(spark):
    rows = quality_ledger.ledger(table(spark, SMALL, "documents"))
    measures = [r.m.asDict() for r in rows.select("m").collect()]
    fails = [{name for name, rule in quality_ledger.RULES.items() if eval(rule, {}, m)} for m in measures]  # noqa: S307
    kept = {}
    for policy in quality_ledger.POLICIES:
        got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality_ledger.ablation(rows, policy).collect()}
        mine = [f & set(policy.rules) for f in fails]
        assert got == {rule: (sum(rule in f for f in mine), sum(f == {rule} for f in mine), sum(not f - {rule} for f in mine))
                       for rule in policy.rules}
        kept[policy.version] = sum(not f for f in mine)
        assert rows.where(quality_ledger.passes(policy)).count() == kept[policy.version]
    assert kept["base"] >= kept["v1"] >= kept["v2"] > 0


def test_noisy_or_equals_loops():
    rng = np.random.default_rng(2)
    document = np.sort(rng.integers(0, 20, 100))
    logits = rng.normal(0, 4, 100)
    got = toxicity.noisy_or(logits, document, 20)
    for d in range(20):
        rest = 1.0
        for z in logits[document == d]:
            rest *= 1 - 1 / (1 + math.exp(-z))
        assert abs(got[d] - (1 - rest)) < 1e-9


def test_the_sample_holds_one_text_an_id(spark):
    """A third of all rows under one id add one text to the fit."""
    prepare(spark)
    docs = [(7, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(100, 1100)]
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, i % 2) for i in range(100, 1100)]], "doc_id long, toxic int")
    rows = toxicity.sample(spark.createDataFrame(docs, "doc_id long, text string"), labels, 100, 1 << 15).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) <= 200
    whole = toxicity.sample(spark.createDataFrame(docs, "doc_id long, text string"), labels, 10_000, 1 << 15).where("doc_id = 7").collect()
    assert [(r.doc_id, r.toxic) for r in whole] == [(7, 1)]


def test_texts_that_spell_added_tokens():
    """Ids equal the library's for texts with the spelling of an added token, in any case and place."""
    import pyarrow as pa
    from siteatlas.llm.common import tokenizer_file
    from siteatlas.llm.encoding import BulkEncoder
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    spelled = [t.content for t in library.get_added_tokens_decoder().values()]
    assert spelled
    texts = ["Foo<|ENDOFTEXT|>.", "<|STARTOFTEXT|>", "A < b <| C |> D.", "<|EndOfText|>,"]
    for token in spelled:
        for form in (token, token.upper(), token.title(), token.swapcase()):
            texts += [form, f"Word{form}Word.", f"{form},", f"x {form} Y", f"{form}{form.lower()}"]
    ids, bounds = BulkEncoder(path).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_encoded_many_at_a_time():
    """Words with marks, digits and accents go to the library joined, not one by one; odd ones still get its ids."""
    import pyarrow as pa
    from siteatlas.llm.common import tokenizer_file
    from siteatlas.llm.encoding import BulkEncoder
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, bulk, alone = Tokenizer.from_file(path), BulkEncoder(path), []
    encode = bulk._encode
    bulk._encode = lambda some: alone.extend(some) or encode(some)
    latin = [f"{word}{i}{end}" for word in ("Été", "don't", "key=", "ÑANDÚ'S", "a²") for i in range(100) for end in ("", "...", "$$$", "é.")]
    latin += ["Straße.", "Élan,", "x***", "'tis", "we'll.", "³½", "...", "ÀÉ"]
    odd = ["a\tb.", "x\xa0y,", "\x85", "H̱.", "İstanbul.", "क़.", "Café.", "Слово,", "中文。", "K", "\x1f", "é"]
    for texts in ([" ".join(latin)], [*latin, *odd], [None, "", "\n", " a  b "], []):
        ids, bounds = bulk.encode(pa.array(texts, pa.string()))
        assert len(bounds) == len(texts) + 1
        for i, text in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert set(alone) <= set(odd)


def test_whole_documents_are_unpacked_once(spark, tmp_path):
    """Asking for the parts of split documents leaves chunks of whole ones packed."""
    from siteatlas.llm import token_files
    from siteatlas.llm.common import prepare, tokenizer_file

    prepare(spark)
    docs = spark.createDataFrame([(1, "a b"), (2, " ".join(["word"] * 50)), (3, None)], "doc_id long, text string")
    token_files.write(docs, str(tmp_path), tokenizer_file("word_bpe_49k.json"), chunk_ids=20)
    split = token_files.read(spark, str(tmp_path)).where("split > 0")
    assert {r.doc_id for r in split.collect()} == {2}
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(split,0)" in plan and "EqualTo(split,0)" not in plan

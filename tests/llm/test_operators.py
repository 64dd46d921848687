"""Small cases with brute-force answers: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bpe, chat, common, exact_dedup, langid, license_scan, mixing, near_dedup, neighbours, phrases, queries, repeats

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
draw = random.Random(3)
VOCABULARY = ["w%d" % i for i in range(400)]
BASE = " ".join(draw.choice(VOCABULARY) for _ in range(300))
UNLIKE = [" ".join(draw.choice(VOCABULARY) for _ in range(60)) for _ in range(6)]


def corpus():
    other = BASE.split()
    other[150] = "changed"
    texts = [None, "", " \t\n", BASE, BASE, BASE.replace(" ", "  "), " ".join(other), "x" * 30_000, "short text", "The MIT License. GNU general\npublic, LICENSE", "aé" * 900, " ".join(BASE.split()[40:90]), "one two three"]
    texts += UNLIKE
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4], i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[8]]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    extra = {c: F.lit("x") for c in ("ids", "digest", "row", "content", "id", "kept", "words", "anchor", "group_size", "lang_pred", "score")}
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, none):
    assert bpe.encode_decode(none, queries.vocabulary()).count() == 0
    assert license_scan.license_scan(none).count() == 0
    assert phrases.remove_phrases(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert near_dedup.jaccard_join(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0


def test_bpe_is_what_the_tokenizer_says(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    got = bpe.encode_decode(docs, queries.vocabulary(), keep=("doc_id", "text")).collect()
    assert len(got) == len(corpus())
    for r in got:
        want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == tokenizer.decode(want, skip_special_tokens=False) == (r["text"] or "")
    with pytest.raises(ValueError, match="ids"):
        bpe.encode_decode(docs, queries.vocabulary(), keep=("doc_id", "ids"))


def test_bpe_on_awkward_texts():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(queries.vocabulary()), bpe.codec(queries.vocabulary())
    pieces = ["a", "Z", "'s", "'re", "!!'", "'", " ", "  ", "\n", " ", " ", "é", "ß", "漢", "😀", "7", "²", "<|endoftext|>", "<|endof", "\t", "\x00", "_", "'S", "\x85", "\x1c", "ll", "…"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(14)))
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(own.encode(text)) == text
    assert len(own.fragments("lorem ipsum dolor")) >= 3


def test_license_scan(docs):
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    r = got[9]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (7, 2, 1, 3, "gpl,mit", 1.0)
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["labels"], got[0]["score"]) == (0, 0, None, "", 0.0)


def test_licenses_of_rows_without_an_id(spark):
    rows = [(5, "Released under the MIT permission licence"), (None, "Released under the MIT permission licence"), (None, "x"), (None, None)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in got) == [("5", "mit", 0.8), ("None", "", 0.0), ("None", "", 0.0), ("None", "mit", 0.8)]


def test_license_templates(spark):
    rows = [(1, "Licensed under license: Apache, version 2.0\nnothing"), (2, "Released. under the MIT\nLicense"), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that following conditions are met")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "apache-2.0" and got[1]["base_labels"] == "" and got[1]["score"] == pytest.approx(7 / 8)
    assert got[2]["labels"] == "mit" and got[3]["labels"] == "bsd"


def test_turn_order_is_a_registered_verdict(spark, tmp_path):
    turns = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "a"), (2, 1, "user", "b"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, None, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["valid"] for r in queries.queries()["op8_turn_order"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, -7: True}


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    rows = [(i, t, None, "a", 1) for i, t in enumerate(["clean words", "漢字", "é", "12 _ !", "", None])]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2] and {r["lang"] for r in got} == {None}


WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction",
    "bsd": "Copyright someone\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Keep this",
    "mpl-2.0": "/* This Source Code Form is subject to the\n * terms of the Mozilla Public License, v.\n * 2.0. If a copy */",
}


def brute_templates(text, threshold=0.8):
    pattern = re.compile(license_scan.WORD)
    lower = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    parts, best = [[]], {}
    for line in lower.split("\n"):
        found = pattern.findall(line)
        parts[-1] += found
        if not found:
            parts.append([])
    for label, template, telling in license_scan.TEMPLATES:
        n, wanted = license_scan.WINDOW * len(template.split()), set(template.split())
        held = [p[i : i + n] for p in parts for i in range(len(p)) if set(telling.split()) <= set(p[i : i + n])]
        c = max((len(wanted & set(h)) for h in held), default=0) / len(wanted)
        if c >= threshold - 1e-9:
            best[label] = max(c, best.get(label, 0))
    return best


def test_licenses_that_look_like_others(spark):
    said = {
        "This software is released under the Apache License": "apache",
        "released under the GPL license, version 3": "",
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY 4.0": "cc-by",
        "released things under the " + "other " * 3000 + "license of the mit": "",
        "x " * 3000 + "released under the MIT license " + "y " * 3000: "mit",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
    }
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == dict(enumerate(said.values()))


def test_license_templates_wrapped_over_lines(spark):
    words = sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()}) + ["other"] * 20
    texts = list(WRAPPED.values()) + ["Some words before\n" + t.replace("\n", "\n\n") for t in WRAPPED.values()]
    texts += ["\n".join(t.split()) for _, t, _ in license_scan.TEMPLATES] + [None, "", "\n\n", "Released under\n" + "other " * 8 + "the license"]
    for _, t, _ in license_scan.TEMPLATES * 8:
        mixed = t.split()
        for _ in range(draw.randrange(12)):
            mixed.insert(draw.randrange(len(mixed)), draw.choice(words))
        texts.append("".join(w + draw.choice([" ", " ", "\n", "\n * ", "\n\n"][: draw.choice([3, 4, 5])]) for w in mixed))
    rows = list(enumerate(texts))
    got = {i: {} for i, _ in rows}
    for r in license_scan.template_hits(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]][r["label"]] = r["containment"]
    assert [set(got[i]) for i in range(3)] == [{label} for label in WRAPPED]
    for i, text in rows:
        assert got[i] == pytest.approx(brute_templates(text)), repr(text)
    scanned = license_scan.license_scan(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert {r["labels"] for r in scanned} == set(WRAPPED) and min(r["score"] for r in scanned) >= 0.8


def brute_phrases(rows, window):
    words, seen, out = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}, set(), {}
    for i in sorted(words):
        gone = set()
        for k in range(len(words[i]) - window + 1):
            w = tuple(words[i][k : k + window])
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        out[i] = (len(words[i]), len(gone), " ".join(w for k, w in enumerate(words[i]) if k not in gone))
    return out


def test_phrases_against_brute_force(spark, docs):
    want = brute_phrases({(r[0], r[1]) for r in corpus()}, 20)
    got = phrases.remove_phrases(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]], r["doc_id"]


def test_phrases_on_dense_repeats(spark):
    rows = [(i, " ".join(draw.choice("ab") if i % 2 else draw.choice("abc") for _ in range(200))) for i in range(12)] + [(20, "a " * 100), (21, "a " * 90)]
    want = brute_phrases(rows, 20)
    for r in phrases.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]], r["doc_id"]


def brute_repeats(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = defaultdict(int)
    for _, d in data:
        for k in range(len(d) - length + 1):
            count[d[k : k + length]] += 1
    for i, d in data:
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        yield i, (len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(b for b, g in zip(d, gone[1:]) if not g))


def test_repeats_against_brute_force(docs):
    rows = [(r[0], r[1]) for r in corpus()]
    want = dict(brute_repeats(rows, 400))
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


def test_repeats_of_many_unlike_contexts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CONTEXTS", 5)  # more blocks than one
    core = "".join(draw.choice("abcdefgh ") for _ in range(700))
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(300) + core[draw.randrange(200) : 700 - draw.randrange(200)] + noise(300)) for i in range(25)]
    want = dict(brute_repeats(rows, 400))
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


def test_mix_meets_its_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i < 400 else "mid" if i < 480 else "small") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy=0.8, max_passes=50.0, block_rows=30).collect()
    size = {s: sum(1 + i % 7 for i, _, x in rows if x == s) for s in ("big", "mid", "small")}
    total = sum(size.values())

    def weights(a):
        raised = {s: (n / total) ** a for s, n in size.items()}
        return {s: r / sum(raised.values()) for s, r in raised.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values()) / math.log(3)
    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if entropy((low + high) / 2) >= 0.8 else (low, (low + high) / 2)
    for s, w in weights(low).items():
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["mix_weight"] == pytest.approx(w, abs=1e-6)
        due, got = round(w * total), sum(r["mix_tokens"] for r in mine)
        assert due <= got < due + 7
        for p in range(due // size[s]):
            assert sorted(r["doc_id"] for r in mine if r["mix_pass"] == p) == [i for i, _, x in rows if x == s]
        last = sorted((r["mix_block"], r["mix_key"], r["mix_tokens"]) for r in mine if r["mix_pass"] == due // size[s])
        assert sum(n for *_, n in last[:-1]) < max(1, due % size[s])
    limited = mixing.mix(df, entropy=0.99, max_passes=2.0).groupBy("source").agg((F.sum("mix_tokens")).alias("n")).collect()
    assert all(r["n"] <= 2 * size[r["source"]] + 7 for r in limited)


@pytest.mark.parametrize("budget", [2000, 12_000])
def test_mix_ends_between_copies(spark, budget):
    rows = [(1, "w " * 10, "a", i % 3) for i in range(1000)] + [(i, "w " * 40, "b", 0) for i in range(10)] + [(99, "", "a", 0)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for table in (df,) if budget == 2000 else (df.drop("n"),):
        out = mixing.mix(table, budget=budget, entropy=0.0, max_passes=50.0).collect()
        for s, size, longest in (("a", 10_000, 10), ("b", 400, 40)):
            due = round(budget * size / 10_400)
            got = sum(r["mix_tokens"] for r in out if r["source"] == s)
            assert due <= got < due + longest, (s, due, got)


def test_mix_of_odd_rows(docs):
    out = mixing.mix(docs).collect()
    assert {r["source"] for r in out} == {"a", "b", None}
    with pytest.raises(ValueError, match="mix_pass"):
        mixing.mix(docs.withColumn("mix_pass", F.lit(1)))


def brute_links(rows):
    sets = [(i, set(near_dedup.shingle_set(t, 5).tolist())) for i, t in rows]
    links, parent = [0] * len(sets), list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(len(sets)):
            x, y = sets[a][1], sets[b][1]
            if a != b and x and y and len(x & y) / len(x | y) >= 0.8:
                links[a] += 1
                parent = [min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for p in parent]
    smallest = {p: min(sets[k][0] for k in range(len(sets)) if parent[k] == p) for p in parent}
    return sorted((sets[k][0], smallest[parent[k]], links[k]) for k in range(len(sets)))


def test_unlike_texts_of_one_id(spark):
    base = BASE.split()
    rows = [(7, BASE), (8, " ".join([*base[:-1], "changed"])), (7, " ".join(UNLIKE[0].split())), (None, BASE), (None, UNLIKE[1]), (None, UNLIKE[1])]
    got = near_dedup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 7, 2), (8, 7, 2), (7, 7, 0), (None, 7, 2), (None, None, 1), (None, None, 1)], key=str)


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_against_brute_force(spark, docs, block):
    near = []
    for i in range(30):
        words = BASE.split()[:120]
        for _ in range(draw.randrange(4)):
            words[draw.randrange(120)] = "other"
        near.append((100 + i, " ".join(words)))
    rows = [(r[0], r[1]) for r in corpus()] + near
    got = near_dedup.jaccard_join(docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string")), recall=0.999999, block=block)
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    got = dict(map(tuple, common.components(edges, common.work_dir(spark, "chain")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 80: 80, 90: 80}


def test_bands_reach_their_recall():
    bands, rows = near_dedup.choose_bands(0.8, 0.999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_language_id(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op7_language_id(spark, SF).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.train(docs.where("lang IS NOT NULL"))
    odd = {r["doc_id"]: r for r in langid.identify(docs.select(*DOCS_NAMES), model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[3]["lang_pred"] in ("en", "de")
    assert langid.Model([]).predict(["word"]) == (["und"], [0.0])


DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id_backs_off():
    entries = lambda *e: langid.Entries.fitted(pa.array([x[0] for x in e]), np.array([x[1] for x in e]), np.array([x[2] for x in e]), 2)
    model = langid.Model(["a", "b"], entries(("known", 0, 9), ("known", 1, 1)), entries(("xy", 1, 5), ("z", 0, 5)))
    assert model.predict(["known", "zxyz", "1234 !", None])[0] == ["a", "b", "und", "und"]


def brute_language(labelled, texts):
    """The same model with dictionaries, a word at a time."""
    counts = {True: defaultdict(lambda: defaultdict(int)), False: defaultdict(lambda: defaultdict(int))}
    for text, lang in set(labelled):
        for w in langid.words(text):
            counts[True][w][lang] += 1
            for n in range(1, langid.LONGEST_GRAM + 1):
                for g in langid.grams(w, n):
                    counts[False][g][lang] += 1
    languages = sorted({lang for _, lang in labelled})

    def log(kind, entry):
        total = {x: sum(c[x] for c in counts[kind].values()) + langid.SMOOTH * len(counts[kind]) for x in languages}
        return [math.log((counts[kind][entry][x] + langid.SMOOTH) / total[x]) for x in languages]

    for text in texts:
        found, sums = langid.words(text), [0.0] * len(languages)
        for w in found:
            rows = [log(True, w)] if w in counts[True] else []
            for n in range(langid.LONGEST_GRAM, 0, -1):
                rows = rows or [log(False, g) for g in langid.grams(w, n) if g in counts[False]]
            for r in rows:
                sums = [s + x / len(rows) for s, x in zip(sums, r)]
        if not found:
            yield "und", 0.0
            continue
        share = [math.exp((s - max(sums)) / len(found) ** 0.5) for s in sums]
        yield languages[sums.index(max(sums))], max(share) / sum(share)


def test_language_id_against_brute_force(spark):
    rows = [("the cat sat on a mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the dog", "en"), ("the dog", "en"), ("", "en"), ("the dog", "de")]
    texts = ["the chat", "hunden", "xyzzy qwrt", "", None, "12 _", "der der le", "ça été ß", "the " * 30_000 + "hund", "katze!katze"]
    model = langid.train(spark.createDataFrame([*rows, (None, "en"), ("le", None)], "text string, lang string"))
    asked = spark.createDataFrame(list(enumerate(texts)) + [(6, "der der le")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(asked, model).collect())
    want = list(brute_language(rows, texts))
    want = sorted((i, *want[i]) for i in [*range(len(texts)), 6])
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_language_model_is_bounded_by_its_sample(spark):
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = spark.createDataFrame([(f"x{name(i)} y{name(i)}", "en") for i in range(400)], "text string, lang string")
    small = langid.train(rows, chars_per_language=1000)
    assert 20 < len(small.known.names) < 400 and len(langid.train(rows).known.names) == 800


def test_chat(spark):
    rows = [(1, 0, "system", "be <|end|>\n nice"), (1, 1, "user", None), (1, 2, "assistant", "&lt; [x] |"), (2, 0, "assistant", "first"), (2, 0, "assistant", "first"), (3, 5, None, ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))
    found = chat.format_chats(df).withColumn("text", chat.formatted(F.col("segments"))).withColumn("turns", chat.read_back(F.col("text")))
    got = {r["conv_id"]: r for r in found.withColumn("learned", chat.unescape(chat.formatted(F.col("segments"), True))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("system", "be <|end|>\n nice"), ("user", ""), ("assistant", "&lt; [x] |")]
    assert got[1]["valid"] and got[1]["learned"] == "&lt; [x] |" and got[1]["text"].count("<|end|>\n") == 3
    assert not got[2]["valid"] and got[2]["learned"] == "firstfirst"
    assert not got[3]["valid"] and got[3]["learned"] == "" and [tuple(t) for t in got[3]["turns"]] == [("", "")] and got[None]["valid"]


def test_chat_machine_decides(spark):
    """Another template, other moves: what is learned, and what is valid, follows from the states alone."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "tool", "d"), (2, 0, "assistant", "x"), (2, 1, "user", "y")]
    rows += [(3, i, ("user", "assistant")[i % 2], "long") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("learned", chat.formatted(F.col("segments"), True)).collect()}
    assert {k: r["valid"] for k, r in plain.items()} == {1: False, 2: False, 3: True}
    assert (plain[1]["learned"], plain[2]["learned"], len(plain[3]["learned"])) == ("bc", "x", 6000)
    first_only = chat.Template(moves={"start": {"user": "asked"}, "asked": {"assistant": "first"}, "first": {"assistant": "again"}, "again": {"tool": "again"}}, astray={}, learned=("first",))
    other = {r["conv_id"]: r for r in chat.format_chats(df, first_only).withColumn("learned", chat.formatted(F.col("segments"), True)).collect()}
    assert (other[1]["valid"], other[1]["learned"]) == (True, "b") and (other[2]["valid"], other[2]["learned"]) == (False, "") and not other[3]["valid"]


def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for i, q in usable:
        if i % 20 == 0:
            found = sorted((-float((v * q).sum()), j) for j, v in usable if j != i and len(v) == len(q))
            yield from ((i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))


def test_nearest_odd_vectors(spark):
    rows = [(i, [float(i % 5), 1.0, 0.0]) for i in range(50)] + [(60, None), (80, []), (100, [0.0, 0.0, 0.0]), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (120, [1.0, 2.0]), (121, [3.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("rank", F.lit(1))
    got = sorted(map(tuple, neighbours.nearest(df, block=16, query_batch=2, most_queries=2, sure=0.999999).collect()))
    want = sorted(brute_nearest(rows, 20))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {(w[0], w[2]) for w in brute_nearest(rows, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in queries.op9_nearest(spark, sf).collect()}
    recall = len(want & got) / len(want)
    print("recall", recall)
    assert len(got) == len(want) and recall >= 0.9


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0]))
        yield from ((r[0], keep[0], len(own), hashlib.sha256(norm.encode()).hexdigest()) for r in own)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_against_brute_force(docs, files):
    got = exact_dedup.exact_dedup(docs, files_per_batch=files).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(brute_exact(corpus()))
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_tells_colliding_digests_apart(docs):
    weak = lambda normal: F.substring(F.sha2(normal.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_dedup(docs, digest=weak).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted(x[:3] for x in brute_exact(corpus()))


def test_pipeline(spark):
    import corpus_pipeline

    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, SF), common.work_dir(spark, name))
        if name != "tokenise":
            assert after.columns == columns, name
        if name == "exact":
            assert after.count() == before.select(exact_dedup.normalised(F.col("text"))).distinct().count()
        if name == "near":
            assert near_dedup.jaccard_join(after).where("n_links > 0").count() == 0
        before = after
    assert before.where("NOT round_trip").count() == 0 and before.count() > 0


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = corpus() + [(None, BASE, None, None, None), (None, None, None, None, None), (3, BASE, "fr", "zz", 7), (2, "one other text in words that nobody else has", "en", "a", 1)]
    extra = {c: F.lit("mine") for c in ("lang_pred", "score", "ids", "decoded", "mix_key", "mix_source", "row", "content", "group", "n_tokens", "kept", "__text")}
    return spark.createDataFrame(rows, DOCS).repartition(2).withColumns(extra)


def test_stages_take_odd_rows(spark, odd_docs, none):
    import corpus_pipeline

    before, extra = odd_docs, [c for c in odd_docs.columns if c not in DOCS_NAMES]
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, ""), common.work_dir(spark, name))
        rows, had = [r.asDict() for r in after.collect()], [r.asDict() for r in before.collect()]
        if name != "tokenise":
            assert after.columns == odd_docs.columns and all(r[c] == "mine" for r in rows for c in extra)
        texts = lambda x: sorted(r["text"] or "" for r in x)
        if name == "language":
            assert texts(rows) == texts(r for r in had if re.search(r"[^\W\d_]", r["text"] or "")) and all(r["lang"] for r in rows)
        elif name == "exact":
            normal = lambda t: re.sub(r"\s", "", t or "")
            assert sorted({normal(r["text"]) for r in had}) == sorted(normal(r["text"]) for r in rows)
        elif name == "near":
            linked = {r[0] for r in brute_links([(i, r["text"]) for i, r in enumerate(had)]) if r[0] == r[1]}
            assert len(rows) == len(linked) and any("nobody else" in r["text"] for r in rows)
        elif name == "mix":
            assert {r["source"] for r in rows} == {r["source"] for r in had if r["text"]}
        else:
            assert all(r["round_trip"] for r in rows) and len(rows) == len(had) and all(len(r["ids"]) == r["n_tokens"] for r in rows)
        before = after
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_near_stage_drops_by_text_not_by_id(spark):
    import corpus_pipeline

    rows = [(1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, UNLIKE[0], "en", "a", 1), (3, BASE, "en", "a", 1), (1, BASE, "de", "b", 2)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"], r["text"] == BASE, r["lang"]) for r in got) == [(1, True, "de"), (2, False, "en")]


def test_nearest_over_several_cells(spark):
    """Recall where queries go from cell to cell, on clustered vectors with copies, and without a test every pair."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    vectors = centres[rng.integers(0, 30, 6000)] + 0.6 * rng.standard_normal((6000, 24))
    vectors[:400] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(w[0], w[2]): w[3] for w in brute_nearest(rows, 20)}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.nearest(df, block=700, query_batch=64).collect()}
    recall = len(want.keys() & got.keys()) / len(want)
    print("recall", recall)
    assert len(got) == len(want) and recall >= 0.9
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want.keys() & got.keys())


def test_queries_by_brute_force(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    for r in queries.op1_bpe(spark, SF).collect():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids[r["doc_id"]]), hashlib.sha256(",".join(map(str, ids[r["doc_id"]])).encode()).hexdigest())
    assert sorted(map(tuple, queries.op5_jaccard_join(spark, SF).collect())) == brute_links([tuple(r) for r in rows])


def test_no_language_is_lost_in_the_sample(spark):
    german = [(f"Der Hund und die Katze schlafen {i} " * 90_000, "de") for i in range(3)]
    english = [(f"the dog and the cat sleep {i}", "en") for i in range(50)]
    odd = [("1 2 3", "none"), (None, "none"), ("... " * 10 + "un chien", "fr")]
    model = langid.train(spark.createDataFrame(german + english + odd, "text string, lang string"), chars_per_language=1000)
    assert model.languages == ["de", "en", "fr"]
    assert model.predict(["der Hund schläft", "the cat", "chien", "12"])[0] == ["de", "en", "fr", "und"]


def test_a_budget_that_ends_between_copies_with_a_map(spark):
    docs = spark.createDataFrame([(1, "four words of text", "a", {"k": 1})] * 9, "doc_id long, text string, source string, more map<string, int>")
    found = mixing.mix(docs, budget=20).collect()
    assert len(found) == 5 and all(r["more"] == {"k": 1} for r in found)


def test_a_phrase_in_very_many_passages_is_compared_at_once():
    import time

    from tabulon.llm.phrases import Automaton

    hot = [f"h{k}".encode() for k in range(20)]
    found = Automaton(20)
    for k in range(2000):
        found.add(k, 0, b" ".join([b"a%d" % k, *hot, b"b%d" % k]))
    found = found.compiled()
    start = time.monotonic()
    got = found.locate(5000, b" ".join([*hot, b"x", b"a7", *hot, b"b7", *([b"y", *hot] * 100)]))
    assert got == ([0, 21, *range(44, 44 + 2100, 21)], [20, 43, *range(64, 64 + 2100, 21)])
    assert time.monotonic() - start < 2.5
    assert found.locate(7, b" ".join([b"a7", *hot, b"b7"]))[0] == [1]
    assert Automaton(20).compiled().locate(1, b" ".join(hot)) == ([], [])


def test_words_are_hashed_without_an_object_for_each(monkeypatch):
    """As splitting says what a word is, wherever pieces end, and in far less than its time."""
    import time

    from tabulon.llm import shingles

    draw = random.Random(5)
    text = b"".join(bytes(draw.choices(range(256), k=draw.choice((1, 3, 9, 400)))) + draw.choice((b" ", b"\n\t", b"\r\x0b \x0c")) for _ in range(3000))
    for whole in (b"", b" \n", b"a", b" a  b\n", text, text.split()[0] * 9, b"x " * 70 + b"y" * 400 + b" x"):
        seen = []
        for piece in (64, 1 << 10, 1 << 16):
            monkeypatch.setattr(shingles, "PIECE", piece)
            hashes, starts, lengths = shingles.hashed_words(whole)
            assert [whole[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())] == whole.split()
            assert lengths.tolist() == list(map(len, whole.split()))
            assert len(set(zip(hashes.tolist(), whole.split()))) == len(set(hashes.tolist())) == len(set(whole.split()))
            seen.append(hashes.tolist())
        assert seen[1] == seen[2] or max(lengths.tolist(), default=0) > 1 << 10
    rare = b" ".join(b"%x" % draw.getrandbits(40) for _ in range(1_000_000))
    start = time.monotonic()
    hashes = shingles.hashed_words(rare)[0]
    assert time.monotonic() - start < 0.4
    assert len(np.unique(hashes)) == len(set(rare.split()))


def test_texts_hashed_together_are_hashed_alone():
    draw = random.Random(7)
    texts = [None, b"", *[b" ".join(b"w%d" % draw.randrange(90) for _ in range(draw.choice((3, 19, 20, 21, 200)))) + b" \n" * draw.randrange(3) for _ in range(60)], b" "]
    texts.append(texts[-2])
    ids = np.arange(100, 100 + len(texts))
    found = list(zip(*map(np.ndarray.tolist, phrases.seen_anchors(ids, texts, 20))))
    alone = [x for k, t in enumerate(texts) for x in zip(*map(np.ndarray.tolist, phrases.seen_anchors(ids[k : k + 1], [t], 20)))]
    assert found == alone and sum(n for *_, n in found) == sum(len(phrases.Windows([t], 20).anchors()) for t in texts) > 300
    known = np.array([a for a, _, _ in found][::3])
    hashes, n = phrases.candidates(texts, known, 20)
    each = [phrases.candidates([t], known, 20) for t in texts]
    assert hashes.tolist() == [h for e, _ in each for h in e.tolist()] and n.tolist() == [len(e) for e, _ in each]


def test_alike_by_hash_is_compared_word_by_word():
    """Words of a document whose hashes are a passage's without being its words stay."""
    found = phrases.Automaton(20)
    passage = [b"p%d" % k for k in range(70)]
    found.add(1, 0, b" ".join(passage))
    found = found.compiled()
    text = passage[:30] + [b"other"] + passage[31:]
    found.known[30] = phrases.hashed_words(b"other")[0][0]
    assert found.locate(2, b"\n ".join(text)) == ([0, 31], [30, 70])
    assert found.locate(1, b" ".join(passage)) == ([], [])

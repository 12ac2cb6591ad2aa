import binascii
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import AWKWARD, SF, by_id, clash, docs, given

from tracelode.llm import language_id, license_scan, pii, toxicity
from tracelode.session import FREE


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def is_held_out(i):
    return binascii.crc32(str(i).encode()) % 4 == 2


def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Awful,", "nasty", "VILE."])
        texts.append(" ".join(w))
        marks.append((i, 1, int(toxic)))
    texts += [None, "", "nasty " * 30_000, "clean " * 30_000]
    got = by_id(toxicity.classify(clash(docs(spark, texts)), labels(spark, marks + [(9999, 1, 1), (3, 1, None), (None, 1, 1)])))
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == is_held_out(i) for i in got)
    wrong = sum(got[i]["predicted"] != marks[i][2] for i in range(400))
    assert wrong <= 4 and got[402]["predicted"] == 1 and got[403]["predicted"] == 0
    assert got[400]["score"] == got[401]["score"]


def test_toxicity_without_labels(spark):
    got = by_id(toxicity.classify(docs(spark, ["a", None]), labels(spark, [])))
    assert [got[i]["predicted"] for i in (0, 1)] == [0, 0]
    assert toxicity.classify(docs(spark, []), labels(spark, [(1, 1, 1)])).collect() == []


def brute_kneser_ney(train, prior=toxicity.PRIOR, discount=toxicity.DISCOUNT):
    """Summed log-ratio of a text, from (words, class) of the training texts, over dictionaries of all pairs."""
    pairs = [(set(zip([None, *words], words, strict=False)), c) for words, c in train]
    count = [Counter(p for ps, k in pairs if k == c for p in ps) for c in (0, 1)]
    having = [Counter(w for ps, k in pairs if k == c for w in {w for _, w in ps}) for c in (0, 1)]
    texts = [sum(k == c for _, k in train) for c in (0, 1)]
    known, vocabulary = set(count[0]) | set(count[1]), {w for h in having for w in h}
    types = Counter(w for _, w in known)
    floor = {w: (types[w] + 0.5) / (len(known) + 0.5 * (len(vocabulary) + 1)) for w in vocabulary}
    of = [[sum(n for (_, w), n in count[c].items() if w == word) for word in vocabulary] for c in (0, 1)]
    of = [dict(zip(vocabulary, one, strict=True)) for one in of]
    unigram = [{w: max(of[c][w] - discount, 0) / sum(of[c].values()) + discount * sum(n > 0 for n in of[c].values()) / sum(of[c].values()) * floor[w]
                for w in vocabulary} for c in (0, 1)]
    # The shares of a class sum to one, but for what is kept for unknown words.
    assert all(abs(sum(one.values()) - 1) < 0.2 and sum(one.values()) <= 1 + 1e-9 for one in unigram)
    likelihood = lambda n, m: n * np.log(n / m) if n > 0 and m > 0 else 0.0
    trust = lambda x: 1 / (1 + np.exp(prior - min(x, 100)))
    rate = [t / sum(texts) for t in texts]

    def word(w):
        both = having[0][w] + having[1][w]
        ratio = sum(likelihood(having[c][w], both * rate[c]) + likelihood(texts[c] - having[c][w], (sum(texts) - both) * rate[c]) for c in (0, 1))
        return trust(ratio) * np.log(unigram[1][w] / unigram[0][w])

    def pair(before, w):
        if (before, w) not in known:
            return 0.0
        after = [[n for (b, _), n in count[c].items() if b == before] for c in (0, 1)]
        back = [unigram[0][w], unigram[0][w] * np.exp(word(w))]
        own = [max(count[c][before, w] - discount, 0) / sum(after[c]) + discount * len(after[c]) / sum(after[c]) * back[c] if after[c] else back[c] for c in (0, 1)]
        odds, n = np.exp(word(w)) * rate[1] / rate[0], count[0][before, w] + count[1][before, w]
        ratio = likelihood(count[0][before, w], n / (1 + odds)) + likelihood(count[1][before, w], n * odds / (1 + odds))
        return trust(ratio) * (np.log(own[1] / own[0]) - word(w))

    return lambda words: sum((word(w) if w in vocabulary else 0.0) + pair(b, w) for b, w in set(zip([None, *words], words, strict=False)))


def test_log_ratios_against_brute_force(spark):
    """Production's counts, joins and sums, over texts with rare, shared and unknown words, repeats and none."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("a b c d e f g".split(), k=rng.randrange(12)) + ["bad mean"] * (i % 2) * 2 + [f"only{i}"] * (i % 5 == 0)) for i in range(120)]
    marks = [(i, 1, i % 2) for i in range(100)]
    got = by_id(toxicity.classify(docs(spark, texts + [None, "never seen words", "bad mean bad"]), labels(spark, marks)))
    total = brute_kneser_ney([(texts[i].split(), toxic) for i, _, toxic in marks if not is_held_out(i)])
    for i, text in enumerate(texts + ["", "never seen words", "bad mean bad"]):
        assert got[i]["log_ratio"] == pytest.approx(total(text.split()), rel=1e-4, abs=1e-5), text
        assert got[i]["n_words"] == len(set(zip([None, *text.split()], text.split(), strict=False)))


def test_language_on_held_out_rows(spark):
    got = by_id(language_id.identify(clash(given(spark))))
    truth = {r.doc_id: r.lang for r in given(spark).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert held and all(is_held_out(i) for i in held)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.95


def test_language_of_awkward_texts(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in given(spark).limit(80).collect()]
    texts = [t for _, t, _ in rows] + AWKWARD
    langs = [x for _, _, x in rows] + [None] * len(AWKWARD)
    got = by_id(language_id.identify(docs(spark, texts, langs=langs)))
    for i, text in enumerate(texts):
        letters = any(map(str.isalpha, text or ""))
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    none = by_id(language_id.identify(docs(spark, ["a", None], langs=[None, None])))
    assert {r["lang_pred"] for r in none.values()} == {"und"}


def test_languages_beyond_five_hundred_are_learned(spark):
    # Three documents of each of 520 languages, so that none can be left out for being rarer.
    langs = [f"x-{i:03d}" for i in range(520) for _ in range(3)]
    texts = [f"word{lang} other{lang} third{lang}" for lang in langs]
    held = {i for i in range(len(texts)) if is_held_out(i)}
    model = language_id.learn(docs(spark, texts, langs=langs))
    assert model.languages == sorted({lang for i, lang in enumerate(langs) if i not in held})
    assert len(model.languages) > 500 and model.logits.shape == (language_id.BUCKETS, len(model.languages))


def license_words(text):
    folded = (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_license(text):
    w = license_words(text)
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    best, labels_found = 0.0, {label for _, label in found}
    for j in range(0, max(len(w), 1), license_scan.BLOCK // 2):
        block, met = set(w[j:j + license_scan.BLOCK]), {}
        for family, label, template in license_scan.TEMPLATES:
            tokens = set(template.split())
            common = len(block & tokens)
            if 100 * common >= license_scan.THRESHOLD_PERCENT * len(tokens):
                met.setdefault(family, []).append((common / len(tokens), common, label))
        for rivals in met.values():
            top = max(rivals)[:2]
            labels_found |= {label for share, common, label in rivals if (share, common) == top}
            best = max(best, top[0])
    starts = [i for i, _ in found]
    return (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})),
            ",".join(sorted(labels_found)), max(best, 1.0 if found else 0.0))


def test_licenses_against_brute_force(spark):
    rng = random.Random(6)
    texts = AWKWARD + ["All rights  RESERVED. all rights reserved", "cc by cc by", "CC-BY-NC 4.0", "Kcc by", "ccé by", "the GNU general\nPublic\tLicense"]
    for _, _, template in license_scan.TEMPLATES:
        t = template.split()
        filler = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 90))]
        texts += [" ".join(filler + t + filler), " ".join(filler + t[:-1]), " ".join(t[: len(t) // 2])]
    texts += [r.text for r in given(spark).collect()]
    got = by_id(license_scan.scan(clash(docs(spark, texts))))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, text in enumerate(texts):
        assert tuple(got[i][n] for n in names) == pytest.approx(brute_license(text)), text[:200]
    assert license_scan.scan(docs(spark, [])).collect() == []


def test_license_candidates_have_words_enough_left(spark):
    # The first text has words enough of templates, but of none that it shares a prefix word with enough from there on.
    unlicense = next(text for _, label, text in license_scan.TEMPLATES if label == "unlicense").split()
    few = docs(spark, ["gnu affero lesser mozilla v cc0 waiver universal unencumbered into", " ".join(unlicense)])
    order = license_scan.global_order(few)
    index = license_scan.index_of(few, 90, order)
    prefix = sorted({r["token"] for r in index.collect()})
    texts = license_scan.texts_of(few)
    found = license_scan.candidates(texts, index, prefix, order)
    assert all(1 + min(len(r["tokens"]) - r["position"] - 1, len(r["b"]) - 1 - r["b"].index(r["token"])) >= r["least"] for r in found.collect())
    assert {r["label"] for r in license_scan.matches(found).collect()} == {"unlicense"}
    assert len(found.collect()) == 1


#: Notices in usual wordings, labelled by hand.
NOTICES = {
    "This program is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the GNU General Public License version 2 only": "gpl,gpl-2.0",
    "distributed under the terms of the GNU General Public License, version 3 or later": "gpl,gpl-3.0",
    "licensed under the GNU Lesser General Public License version 3": "gpl,lgpl-3.0",
    "You may use it under the GNU Lesser General Public License, version 2.1.": "gpl,lgpl-2.1",
    "licensed under the GNU Affero General Public License version 3": "agpl-3.0,gpl",
    "some general public license": "gpl",
    "Licensed under the MIT License": "mit",
    "released under the MIT license": "mit",
    "Apache License, Version 2.0": "apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the License);": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
    "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Mozilla Public License, version 2.0": "mpl-2.0",
    "All rights reserved.": "reserved",
    "MIT License or the Apache License, Version 2.0, licensed under the user's choice": "apache-2.0,mit",
    "The general was licensed to walk in public under version three of the plan": "",
}


def test_licenses_labelled_by_hand(spark):
    got = by_id(license_scan.scan(docs(spark, list(NOTICES))))
    assert {text: got[i]["labels"] for i, text in enumerate(NOTICES)} == NOTICES


def test_licenses_of_one_id_with_two_texts(spark):
    got = license_scan.scan(docs(spark, ["released under the mit license", "no such words"], [1, 1])).collect()
    assert sorted((r.n_words, r.labels) for r in got) == [(3, ""), (5, "mit")]


def luhn(match):
    d = [int(c) for c in match if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(map(str.isdigit, m)) <= 19 and luhn(m)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(map(str.isdigit, m)) <= 15),
)


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in PATTERNS for m in re.finditer(p, text or "") if ok(m[0])]


def odd_texts(rng, n):
    bits = ["a@b", ".com", "@", "_", "+1", "(555)", "-", ".", " ", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
            "4111111111111111", "5", "12", "é", "😀", "\n", "x.y@z.org", "+49 30 1234567", "00", "a"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_base_spans_against_patterns(spark):
    rng = random.Random(8)
    long = ["1" * 30_000, "a." * 20_000, "a@b" + ".c" * 20_000, "+" + "1(" * 20_000, "1.2.3.4 " * 3_000, "1 " * 20_000, "4111 1111 1111 1111, " * 500]
    texts = AWKWARD + odd_texts(rng, 600) + long + [r.text for r in given(spark).collect()]
    got = by_id(pii.detect(clash(docs(spark, texts))))
    for i, text in enumerate(texts):
        expected = brute_spans(text)
        spans = [s for s in got[i]["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == ["%s:%d:%d" % s for s in expected], text[:200]
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in expected) for k in pii.BASE]


def test_labelers_find_secrets_and_leave_long_words(spark):
    rng = random.Random(2)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'we set token = "{key()}" here' for _ in range(30)] + ["w" * 30 + " and " + "abcdefghij" * 3 for _ in range(30)] + ["ssn 123-45-6780 call 212-555-0100"]
    got = by_id(pii.detect(docs(spark, texts)))
    assert all("secret" in got[i]["spans"] for i in range(30))
    assert not any("secret" in got[i]["spans"] for i in range(30, 60))
    assert pii.detect(docs(spark, [])).collect() == []


def test_masking(spark):
    texts = [None, "", "no data", "mail x.y@z.org now", "é😀 +49 30 1234567 and 1.2.3.4.", "1.2.3.4"]
    frame = docs(spark, texts)
    from pyspark.sql import functions as F

    rows = {r.doc_id: r.m for r in frame.select("doc_id", pii.masked(F.coalesce("text", F.lit("")), {}).alias("m")).collect()}
    assert rows == {0: "", 1: "", 2: "no data", 3: "mail <email> now", 4: "é😀 <phone> and <ip>.", 5: "<ip>"}


def test_masking_of_overlapping_kinds(spark):
    local = "abcDEF0123456789abcDEF01"
    texts = [f"mail {local}@example.org now", f"{local}@example.org", f"key {local} end", "x.y@z.org,1.2.3.4"]
    found = pii.search(docs(spark, texts))
    model = {("secret", c["votes"]): 1.0 for r in found.collect() for c in r["secret"]}
    rows = {r.doc_id: r.m for r in docs(spark, texts).select("doc_id", pii.masked(pii.whole("text"), model).alias("m")).collect()}
    assert rows == {0: "mail <email> now", 1: "<email>", 2: "key <secret> end", 3: "<email>,<ip>"}


def test_labels_table_is_read(spark):
    got = by_id(toxicity.classify(given(spark), spark.read.parquet(f"{SF}/labels.parquet")))
    assert len(got) == 200


def test_toxicity_counts_rare_words_and_every_word(spark):
    rng = random.Random(9)
    texts, marks = [], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 4 == 0
        # Each toxic word stands in about four labelled texts only; there are more such words than any short list holds.
        w += [f"bad{i // 16}x{k}" for k in range(60)] if toxic else [f"good{i // 16}x{k}" for k in range(60)]
        texts.append(" ".join(w))
        marks.append((i, 1, int(toxic)))
    got = by_id(toxicity.classify(docs(spark, texts), labels(spark, marks)))
    held = [i for i in got if is_held_out(i)]
    assert np.mean([got[i]["predicted"] == marks[i][2] for i in held]) >= 0.95


def test_toxicity_by_parts_is_whole_and_frees_its_disk(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(30)) + ["bad mean"] * (i % 2)) for i in range(160)]
    marks = [(i, 1, i % 2) for i in range(140)]
    whole = by_id(toxicity.classify(docs(spark, texts), labels(spark, marks)))
    monkeypatch.setattr(toxicity, "PART_BYTES", 500)
    written = []
    add = toxicity.Table.add
    monkeypatch.setattr(toxicity.Table, "add", lambda self, *a, **b: written.append(self.name) or add(self, *a, **b))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.name.split("_")[1] for top in disk.localDirs() for f in Path(str(top)).rglob("shuffle_*")}
    before = shuffles()
    got = by_id(toxicity.classify(docs(spark, texts), labels(spark, marks)))
    total = brute_kneser_ney([(texts[i].split(), toxic) for i, _, toxic in marks if not is_held_out(i)])
    for i, text in enumerate(texts):
        assert got[i]["log_ratio"] == pytest.approx(total(text.split()), rel=1e-4, abs=1e-5), text
        assert got[i]["score"] == pytest.approx(whole[i]["score"], rel=1e-6)
    # Many parts were made; no table is left, and of some sixty shuffles only those of single counts and of the result itself.
    assert len(written) > toxicity.GRAM_PARTS and not [t.name for t in spark.catalog.listTables() if t.name.startswith("toxicity_")]
    assert len(shuffles() - before) <= 8
    assert spark.conf.get(FREE) == "false"


def test_toxicity_scores_repeated_rows_alike(spark):
    texts = [("vile " if i % 3 == 0 else "fine ") + " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) for i in range(200)]
    marks = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(200)])
    once = by_id(toxicity.classify(docs(spark, texts), marks))
    rows = toxicity.classify(docs(spark, texts + texts[:1] * 2, [*range(200), 900, 900]), marks).where("doc_id in (0, 900)").collect()
    assert len(rows) == 3 and all(r["score"] == pytest.approx(once[0]["score"]) for r in rows)


def test_toxicity_sums_by_blocks(spark, monkeypatch):
    """A chunk sends a range one row, not one for each text and bigram, and the sums are those of each text by itself."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"W{k}" for k in range(40)], k=rng.randrange(30))) for _ in range(60)] + AWKWARD + ["--a  B--", "b a", "\x00 é ü \x7f a"]
    ids = [*range(len(texts)), 3, 3, 70]
    texts += [texts[3], texts[3], texts[70]]
    plain = [(t or "").encode().translate(toxicity.CLEAN).split() for t in texts]
    pairs = [set(zip([None, *words], words, strict=False)) for words in plain]
    hashed = lambda w: int.from_bytes(toxicity.hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
    known = sorted({(b, w) for ps in pairs for b, w in ps if b and rng.random() < 0.7}) + [(None, w) for w in {w for words in plain for w in words if rng.random() < 0.7}]
    value = {p: rng.randrange(-8, 9) / 8 for p in known}
    frame = spark.createDataFrame([(hashed(b) if b else toxicity.ALONE, hashed(w), value[b, w]) for b, w in known], "before long, word long, a double")
    ratios = toxicity.Ratios(toxicity.new_table(spark), 3, 8)
    try:
        ratios.add(frame.select(toxicity.key_of(), toxicity.F.col("a").cast("float").alias("a")), ["a"])
        monkeypatch.setattr(toxicity, "CHUNK_BYTES", 300)
        found = toxicity.summed(spark.createDataFrame([*zip(ids, texts, strict=True)], "id long, text string").repartition(3), ratios, "a")
        got = {r["id"]: r for r in found.collect()}
        assert len(got) == len(set(ids))
        for i, ps in zip(ids, pairs, strict=True):
            total = sum(value.get((None, w), 0.0) + (value.get((b, w), 0.0) if b else 0.0) for b, w in ps)
            assert (got[i]["total"], got[i]["n"], got[i]["copies"]) == (pytest.approx(total), len(ps), ids.count(i))
    finally:
        ratios.table.drop()
    chunk = toxicity.grams([t.encode() if t else None for t in texts])
    assert len(chunk.word) == sum(map(len, pairs)) > 500
    assert toxicity.sent(0, np.array(ids), chunk, 3).num_rows <= 9

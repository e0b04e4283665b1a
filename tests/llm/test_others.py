"""Mixing, packing, quality, chat, toxicity and fingerprints against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprints, mixing, packing, quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    of = defaultdict(int)
    for r in rows:
        of[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(of, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(of.values()), {}, set(order)
    while free:
        rate = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if rate * weight[s] > 3 * of[s]]
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3 * of[s]
            free.discard(s)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == of[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s)
    assert Counter(tuple(r) for r in mixing.mix(docs.repartition(7)).collect()) == Counter(tuple(r) for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_tree_of_many_groups(spark, monkeypatch):
    """More than one level: sums are kept, and copies differ from what is due by less than one."""
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "HELD", 16)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "hot" if i % 3 else "cold") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 400
    for s in ("hot", "cold"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40
        due = mine[0]["target"] / mine[0]["source_size"]
        assert all(due - 1 < r["copies"] < due + 1 for r in mine)


def test_mixing_makes_up_for_long_documents(spark):
    """A document fifty times as long as the others: the short ones make up for it, whichever way it goes."""
    rows = [(0, "w " * 1000, "a")] + [(i, "w " * 20, "a") for i in range(1, 400)] + [(1000 + i, "w " * 300, "b") for i in range(60)]
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= (20 if r["source"] == "a" else 300)


def test_mixing_is_unbiased(spark):
    """Over many sources that are alike, documents are taken as often as they are due, long ones too."""
    rows = [(100 * k + i, "w " * (200 if i == 0 else 10 + i), f"s{k:04d}") for k in range(300) for i in range(12)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["due"] = got.target / got.source_size
    for own in (got[got.doc_id % 100 == 0], got[got.doc_id % 100 == 5], got[got.doc_id % 100 == 11]):
        off = own.copies - own.due
        assert abs(off.mean()) < 4 * off.std() / len(own) ** 0.5 + 1e-9


def test_mixing_rows_alike(spark):
    """Thousands of rows without an id, alike or not, are no slower group: sums hold, and copies are as even as can be."""
    rows = [(None, "w w w", "a")] * 3000 + [(None, "w " * (1 + i % 50), "a") for i in range(3000)] + [(i, "w " * 40, "b") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 6500
    for s in ("a", "b"):
        own = got[got.source == s]
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 50
    assert got[(got.source == "a") & (got["size"] == 3)].copies.nunique() <= 2


def test_mixed_rows(docs, empty):
    due = Counter()
    for r in mixing.mix(docs).collect():
        due[r["doc_id"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == +due
    assert mixing.mixed(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs, length=256).collect()
    expected = Counter()
    for r in rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(empty).count() == 0


def test_packing_over_lanes(spark, monkeypatch):
    monkeypatch.setattr(packing, "LANE", 20)
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(["token"] * rng.randint(1, 90))) for i in range(300)], "doc_id long, text string")
    got = packing.pack(docs, length=64, room=8).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_closes_bins_within_bounds():
    """Places well below the bins that a lane makes: bins close, and few sequences are lost for it."""
    rng = random.Random(6)
    bins, lengths = packing.Bins(4096, 64), [min(4096, int(rng.lognormvariate(6.4, 1))) or 1 for _ in range(8000)]
    for n in lengths:
        bins.put(n)
        assert len(bins.free_of) <= 64
    assert len(bins.closed) > 10 * 64 and bins.made <= 1.01 * sum(lengths) / 4096 + 64


def test_packing_of_whole_table_is_tight(spark):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert got[0] <= 1.01 * got[1] / 4096 + 1


def test_packing_of_rows_alike(spark):
    """Rows without an id that are alike, and a text beyond 256 KiB, each packed for itself."""
    rows = [(None, "token " * 9)] * 500 + [(None, None)] * 20 + [(1, "token " * 60_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=100).collect()
    assert Counter(r["length"] for r in got) == Counter({10: 500, 1: 21, 100: 600})
    spans = defaultdict(set)
    for r in got:
        for at in range(r["offset"], r["offset"] + r["length"]):
            assert at not in spans[r["sequence_id"]]
            spans[r["sequence_id"]].add(at)
    assert all(s == set(range(len(s))) and len(s) <= 100 for s in spans.values())


def test_bins_are_best_fit():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4, 5, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_quality_rules(docs, rows, empty):
    got = Counter(tuple(r[name] for name in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality_rules.verdicts(docs).collect())
    expected = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        ws = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        again = {p for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for p in range(i, i + 8)}
        failed = len(ws) < 20 or 100 * len(again) > 30 * len(ws)
        expected[(doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed)] += 1
    assert got == expected
    assert quality_rules.verdicts(empty).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in quality_rules.verdicts(docs).where("kept").collect())
    assert quality_rules.accepted(empty).count() == 0


def test_quality_rules_keep_clean_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    both = quality_rules.verdicts(docs).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert both.where("kept").count() >= 0.98 * both.count()


#: A few sentences in each language, written for this test.
PROSE = {
    "en": "The bridge was closed for repairs in the spring, and for almost a year the villagers had to take the long road around the lake. Most of them did not complain. They had known for years that the old stones were loose, and the council had set money aside twice before. When the first cars crossed again in May, somebody had tied ribbons to the railing, and the baker handed out rolls to everybody who came by on foot.",
    "de": "Im Frühjahr wurde die Brücke wegen Bauarbeiten gesperrt, und fast ein Jahr lang mussten die Bewohner des Dorfes den langen Weg um den See nehmen. Die meisten beschwerten sich nicht. Sie wussten seit Jahren, dass die alten Steine locker waren, und der Gemeinderat hatte schon zweimal Geld zurückgelegt. Als im Mai die ersten Autos wieder hinüberfuhren, hatte jemand bunte Bänder an das Geländer gebunden.",
    "fr": "Au printemps, le pont fut fermé pour des travaux, et pendant presque un an les habitants du village durent prendre la longue route qui fait le tour du lac. La plupart ne se plaignaient pas. Ils savaient depuis des années que les vieilles pierres ne tenaient plus, et la commune avait déjà mis de l'argent de côté. Quand les premières voitures passèrent de nouveau, quelqu'un avait noué des rubans à la rambarde.",
    "es": "En primavera cerraron el puente por obras, y durante casi un año los vecinos del pueblo tuvieron que tomar el camino largo que rodea el lago. La mayoría no se quejaba. Sabían desde hacía años que las piedras viejas estaban sueltas, y el ayuntamiento ya había apartado dinero dos veces. Cuando en mayo volvieron a cruzar los primeros coches, alguien había atado cintas a la barandilla.",
    "ru": "Весной мост закрыли на ремонт, и почти целый год жителям деревни пришлось ездить по длинной дороге вокруг озера. Большинство не жаловалось. Они давно знали, что старые камни расшатались, и совет уже дважды откладывал деньги. Когда в мае по нему снова поехали первые машины, кто-то привязал к перилам ленты, а пекарь раздавал булочки всем, кто проходил мимо пешком.",
    "el": "Την άνοιξη έκλεισαν τη γέφυρα για επισκευές και σχεδόν έναν χρόνο οι κάτοικοι του χωριού έπρεπε να παίρνουν τον μακρύ δρόμο γύρω από τη λίμνη. Οι περισσότεροι δεν παραπονιούνταν. Ήξεραν από χρόνια ότι οι παλιές πέτρες είχαν χαλαρώσει και το συμβούλιο είχε ήδη βάλει χρήματα στην άκρη δύο φορές.",
}


def brute_verdict(text, lang):
    """The rule again, one document at a time, from the vocabulary itself."""
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=quality_rules.vocabulary("piece_bpe_32k.model"))
    ws = WORD.findall(text or "")
    ids = [i for w in ws for i in model.encode(w)]
    if not ids:
        return False
    letters = Counter()
    for c in text:
        o = ord(c)
        if c.isascii() and c.isalpha() or 0xC0 <= o < 0x280:
            letters["latin"] += 1
        elif 0x340 <= o < 0x400:
            letters["greek"] += 1
        elif 0x400 <= o < 0x540:
            letters["cyrillic"] += 1
    script = max(quality_rules.NAMES, key=lambda name: letters[name])
    band = quality_rules.LANGUAGES.get(lang or "") or quality_rules.SCRIPTS[script]
    share = [n / len(ids) for n in Counter(ids).values()]
    mean, slack = sum(map(len, ws)) / len(ids), band.spread / math.sqrt(len(ws))
    fallback = sum(model.is_byte(i) for i in ids) / len(ids)
    entropy = -sum(p * math.log2(p) for p in share)
    return band.lowest - slack <= mean <= band.highest + slack and fallback <= band.most_fallback and entropy >= min(band.least_entropy, 0.5 * math.log2(max(len(ids), 2)))


def test_quality_rules_verdicts(spark, docs, rows):
    """kept against a rule computed apart, on awkward rows and on whole documents of the test table."""
    more = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for table, own in ((docs, [(r[0], r[1], r[2]) for r in rows]), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), more)):
        expected = Counter()
        failed = {(r["doc_id"], r["n_words"], r["n_tokens"]): r["base_failed"] for r in quality_rules.verdicts(table).collect()}
        verdict = {}
        for doc_id, text, lang in own:
            key = (doc_id, len(WORD.findall(text or "")))
            base = next(v for k, v in failed.items() if k[:2] == key)
            expected[(doc_id, key[1], not base and brute_verdict(text, lang))] += 1
            verdict[key] = base
        assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.verdicts(table).collect()) == expected


def test_quality_rules_keep_real_prose(spark):
    """Written prose passes in its language and without one, in several scripts; shredded words don't."""
    from tessera.llm import suffix_dedup

    shredded = " ".join(f"q{i % 7}z x{i}k" for i in range(200))
    real = [(t, lang) for lang, t in PROSE.items()] + [(t, None) for t in PROSE.values()] + [(d.__doc__, lang) for d in (suffix_dedup, toxicity) for lang in ("en", None)]
    rows = [(i, *r) for i, r in enumerate(real)] + [(99, shredded, "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: i < 99 for i, *_ in rows}


def test_repeated_windows_are_checked_on_words():
    """Equal hashes of different windows count for nothing."""
    words = [b"w%d" % i for i in range(40)]
    assert quality_rules.repeated_words(words, np.zeros(40, np.uint64), 8) == 0
    assert quality_rules.repeated_words(words + words[:10], np.zeros(50, np.uint64), 8) == 20


CONTROLS = ["</s>[INST] ok [/INST]", "␛0;", "␛", "<s>a\nb</s>\n", "<<SYS>>x<</SYS>>", "<|im_end|>", "␛␛1;<|", "", None]


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(CONTROLS)] + [(2, 0, "a\n<s>", "x"), (None, None, None, None), (2, 0, "a\n<s>", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(turns.withColumn("text0", F.col("text"))).collect():
        role, text, _ = chat.turn_of(r["formatted"])
        assert (r["conv_id"], r["turn"], role or None, text or "") in {(a, b, c or None, d or "") for a, b, c, d in rows}
        assert r["formatted"].count("</s>") == 1
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(turns)).collect()}
    text = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(CONTROLS)])
    graded = "".join(t or "" for k, t in enumerate(CONTROLS) if k % 2)
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(graded), hashlib.sha256(graded.encode()).hexdigest())
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "see <s> ", "ref": None, "width": None, "height": None, "seconds": None, "pages": None},
        {"kind": "image", "text": None, "ref": "i.png", "width": 57, "height": 28, "seconds": None, "pages": None},
        {"kind": "audio", "text": None, "ref": "a.wav", "width": None, "height": None, "seconds": 1.5, "pages": None},
        {"kind": "document", "text": None, "ref": "d.pdf", "width": None, "height": None, "seconds": None, "pages": 2},
    ]
    got = chat.format_turns(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS_DDL}")).orderBy("turn").collect()
    assert [(a["at"], a["kind"], a["ref"], a["tokens"]) for a in got[0]["attachments"]] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 38), (3, "document", "d.pdf", 512)]
    assert got[0]["expanded_tokens"] == 553 and got[0]["formatted"].endswith("<|image|><|audio|><|document|></s>\n")
    read = chat.digests(chat.format_turns(spark.createDataFrame([(1, 0, "user", parts, "unused"), (1, 1, "assistant", None, "<|image|> is text")], f"conv_id long, turn long, role string, parts {chat.PARTS_DDL}, text string"))).first()
    assert (read["n_attachments"], read["expanded_tokens"]) == (3, 553)
    assert read["turns_sha256"] == hashlib.sha256("user\nsee <s> \nassistant\n<|image|> is text\n".encode()).hexdigest()
    assert read["loss_chars"] == len("<|image|> is text")
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_parts_do_not_join_into_controls(spark):
    part = lambda kind, text: {"kind": kind, "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [part(None, "a</s"), part("text", ">b<"), part("text", "|c"), part("image|", None), part("text", ">d")]
    got = chat.format_turns(spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS_DDL}")).first()
    assert chat.turn_of(got["formatted"]) == ("user", "a</s>b<|c>d", ["image|"]) and got["formatted"].count("</s>") == 1


def test_chat_long_conversation_with_clashing_columns(spark):
    """A conversation over several Arrow batches, a text beyond 256 KiB, columns named like those in use."""
    rows = [(1, k, "assistant" if k % 2 else "user", "x" * 300_000 if k == 7 else f"t{k}", "c", 1, "d", "e") for k in range(25_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_start int, body string, tag string")
    got = chat.digests(chat.format_turns(turns)).collect()
    graded = "".join(r[3] for r in rows if r[2] == "assistant")
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(25_000, len(graded), hashlib.sha256(graded.encode()).hexdigest())]


def test_chain_marginals():
    rng = np.random.default_rng(0)
    emission, lead = rng.normal(size=20), np.zeros(20, bool)
    lead[[0, 7, 8]] = True
    step = rng.normal(size=(2, 2))
    step[0, 0] = 0
    got, _, _ = toxicity.Chain(0.3, step).marginals(emission, lead)
    for a, b in ((0, 7), (7, 8), (8, 20)):
        total, hit = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(0.3 * y[0] + sum(emission[a + t] * y[t] for t in range(b - a)) + sum(step[y[t - 1], y[t]] for t in range(1, b - a)))
            total, hit = total + weight, hit + weight * np.array(y)
        assert np.allclose(hit / total, got[a:b])


def _auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    y = got.toxic.to_numpy() > 0
    assert _auc(got.score.to_numpy(), y) > 0.9
    assert got.predicted[y].mean() > 0.8 and got.predicted[~y].mean() < 0.02
    assert (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxic_spans(spark):
    clean = [(i, f"ünter the{i % 7} lily of{i % 5} fern", 0) for i in range(200)]
    toxic = [(1000 + i, f"ünter scum, the{i % 7} lily", 1) for i in range(60)]
    docs = spark.createDataFrame(clean + toxic + [(5000, "ünter SCUM! ok", None)], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, docs).collect()}
    assert got[5000]["predicted"] == 1 and [(s["start"], s["end"]) for s in got[5000]["spans"]] == [(6, 10)]
    assert not any(got[i]["predicted"] for i, _, _ in clean)


def test_fingerprints(docs, rows, empty):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    unique = {}
    for r in got:
        unique.setdefault(r["doc_id"], []).append(r)
    # Rows with different ids: the successor is the next row in order; those before a repeated id aren't held to it.
    ids = sorted((r for r in rows if r[0] is not None and r[0] > 6), key=lambda r: r[0])
    for a, b in zip(ids, ids[1:], strict=False):
        cut = len(a[1]) // 4
        changed = a[1][: len(a[1]) - cut] + b[1][:cut]
        r = unique[a[0]][0]
        assert r["n_chars"] == len(a[1]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = {}
    for r in rows:
        if r[0] is not None and r[0] != 6:
            by_text.setdefault(r[1] or "", set()).add(unique[r[0]][0]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) >= len(by_text) - 8
    assert fingerprints.fingerprints(empty).count() == 0


def test_fingerprint_of_last_is_compared_with_first(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame([(9, "ABCDEFGH"), (4, "abcdefgh")], "doc_id long, text string")).collect()}
    assert got[9]["edited_sha256"] == hashlib.sha256(b"ABCDEFab").hexdigest()


def test_fingerprints_across_ranges(spark):
    """Successors over ranges that are empty, and from the last to the first, whatever the number of partitions."""
    rows = [(i, f"text {i} " * (1 + i % 5)) for i in (*range(40), *[100] * 30, 200, 300)]
    ids = {i: t for i, t in rows}
    order = sorted(ids)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
            seen = defaultdict(set)
            for r in got:
                seen[r["doc_id"]].add(r["edited_sha256"])
            for a, b in zip(order, [*order[1:], order[0]], strict=True):
                cut = len(ids[a]) // 4
                assert hashlib.sha256((ids[a][: len(ids[a]) - cut] + ids[b][:cut]).encode()).hexdigest() in seen[a]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parsing_is_locally_consistent():
    rng = np.random.default_rng(1)
    core = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()

    def names(data, level):
        found, row = np.frombuffer(data, np.uint8).astype(np.uint64), np.zeros(len(data), np.int64)
        for _ in range(level):
            found, row = fingerprints.parse(found, row)
        return set(found.tolist())

    for level in (1, 2, 3):
        a, b = names(core, level), names(b"some other beginning " + core + b"end", level)
        assert len(a & b) >= len(a) - 12


def test_parsing_equals_one_by_one():
    """A batch of sequences is parsed as each would be alone; neighbours' labels differ."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 4, int(n)).astype(np.uint64) for n in (0, 1, 2, 5, 40, 300)]
    names, row = fingerprints.parse(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    for i, t in enumerate(texts):
        alone, _ = fingerprints.parse(t, np.zeros(len(t), np.int64))
        assert alone.tolist() == names[row == i].tolist()


def test_near_edited_beats_near_next(spark):
    got = fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.97 and got.near_next.median() < 0.1 and got.near_edited.median() > 0.5


def test_quality_classifier_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y = got.quality.to_numpy() > 0
    assert _auc(got.score.to_numpy(), y) > 0.95 and got.kept[y].mean() > 0.97


def test_quality_classifier_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, split=3).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 < r["score"] < 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    assert quality_classifier.classify(docs, labels.limit(0)).count() == len(rows)
    assert quality_classifier.classify(empty, labels).count() == 0


def test_sites_shrink_to_their_parents(spark):
    """Against the formula, one site at a time."""
    rng = random.Random(3)
    rows = [(h, p, min(max(rng.gauss(m, 0.1), 0.01), 0.99)) for h, m in (("good", 0.95), ("bad", 0.2), (None, 0.6)) for p in ("x", None) for _ in range(40)] + [("tiny", "x", 0.01)]
    got = {(r["host"], r["path"]): r for r in quality_classifier.site_rates(spark.createDataFrame(rows, "host string, path string, p double")).collect()}

    def prior(sites, parent):
        apart = sum(n * (g / n - parent[k]) ** 2 for k, (n, g) in sites.items())
        one, chance = sum(parent[k] * (1 - parent[k]) for k in sites), sum(n * parent[k] * (1 - parent[k]) for k, (n, g) in sites.items())
        between = max(0.0, apart - one) / chance
        return min(max(1 / between - 1 if between else 1e4, 2.0), 1e4)

    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, x in rows:
        for table, key in ((hosts, h), (paths, (h, p))):
            table[key][0] += 1
            table[key][1] += x
    mean = (sum(x for *_, x in rows) + 1) / (len(rows) + 2)
    a = prior(hosts, dict.fromkeys(hosts, mean))
    rate = {h: (g + a * mean) / (n + a) for h, (n, g) in hosts.items()}
    b = prior(paths, {k: rate[k[0]] for k in paths})
    for (h, p), (n, g) in paths.items():
        assert got[h, p]["host_rate"] == pytest.approx(rate[h])
        assert got[h, p]["rate"] == pytest.approx((g + b * rate[h]) / (n + b))
    assert got["tiny", "x"]["rate"] > 0.05


def test_figures_per_text(rows):
    """A batch gives each text the figures that it has alone."""
    import pyarrow as pa

    from tessera.llm.common import raw_text

    texts = [r[1] for r in rows]
    whole = quality_classifier.figures(*raw_text(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality_classifier.figures(*raw_text(pa.array([t], pa.string())))[0])

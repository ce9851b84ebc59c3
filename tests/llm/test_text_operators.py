import collections
import hashlib
import math
import random
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, decontam, langid, licenses, packing, rules, tokens
from gridloom.llm.queries import (
    ORACLE_SQL,
    op2_language_id,
    op3_packing,
    op4_decontamination,
    op7_token_counts,
    op8_quality_rules,
    op10_license_scan,
    tokenizer,
)
from tests.oracle import compare

LOWER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, score string, n_words string"
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "12 34 !!", "en"), (5, "a", "en"), (None, "Some text.", None),
    (6, "don't  <|endoftext|> x  　y\x1cz\r\nÅngström 'S 'LL étude İstanbul <|ENDOFTEXT|>…,'s", "en"), (7, "word " * 40000, "fr"),
    (8, "same same", "de"), (8, "same same", "de"), (9, "z" * 50000, "xx"), (10, "日本語 テキスト 한국어 नमस्ते 😀😀 ok,,,...'", None),
    (11, "tail. tail, tail.*** tail!!, (tail)., é, è.. ñ### ß&&&", "es"), (12, "   lead", "en"), (13, "trail   ", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, la, "x", "y") for i, t, la in ODD], SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def rows(df):
    return [r.asDict() for r in df.collect()]


def docs_of(spark, path):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}


# Token counts and packing, against the library.


def test_token_counts_equal_the_library(spark, tiny, odd):
    lib = library("byte_bpe_50k.json")
    docs = docs_of(spark, tiny)
    for r in rows(op7_token_counts(spark, tiny)):
        n = len(lib.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]]["text"].encode()), n > 512)
    found = tokens.token_counts(odd, tokenizer("byte_bpe_50k.json"))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD]
    assert sorted((tuple(r.values())[:3] for r in rows(found)), key=str) == sorted(expected, key=str)
    assert tokens.token_counts(odd.limit(0), tokenizer("byte_bpe_50k.json")).collect() == []


def test_token_counts_of_random_strings():
    lib, rng = library("byte_bpe_50k.json"), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Word", "é", "12", ".", ",", "'s", "'", "***", " ", "<|endoftext|>", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    assert tokens.count_tokens([t.encode() for t in texts], tokenizer("byte_bpe_50k.json")) == [
        len(lib.encode(t, add_special_tokens=False).ids) for t in texts
    ]


def test_token_counts_with_white_space_of_all_kinds():
    lib, rng = library("byte_bpe_50k.json"), random.Random(7)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    others = ["a", "Word", "é", "12", ".", ",", "'s", "***", "<|endoftext|>", "日", "!", "\u0301"]
    texts = ["".join(rng.choice(spaces if rng.random() < 0.45 else others) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    assert tokens.count_tokens([t.encode() for t in texts], tokenizer("byte_bpe_50k.json")) == [
        len(x.ids) for x in lib.encode_batch_fast(texts, add_special_tokens=False)
    ]


def test_packing_round_trip(spark, tiny, odd):
    lib = library("word_bpe_49k.json")
    found = packing.pack_power_of_two(odd, tokenizer("word_bpe_49k.json")).collect()
    texts = collections.Counter((i, t) for i, t, _ in ODD)
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for (i, t), times in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: (r["start"], r["sequence_id"]))
        lengths = packing.split_lengths(len(ids), 4096)
        assert [r["length"] for r in pieces] == [n for n in lengths for _ in range(times)]
        for r in pieces:
            assert r["ids"] == struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])
            assert r["doc_tokens"] == len(ids) and r["offset"] == 0
    assert len({r["sequence_id"] for r in found}) == len(found)
    docs = docs_of(spark, tiny)
    for r in rows(op3_packing(spark, tiny)):
        ids = lib.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
    assert packing.pack_power_of_two(odd.limit(0), tokenizer("word_bpe_49k.json")).collect() == []
    with pytest.raises(ValueError):
        packing.pack_power_of_two(odd, tokenizer("word_bpe_49k.json"), sequence_length=1000)


def test_buckets_hold_pieces_of_one_length(spark, odd, tmp_path):
    packed = packing.pack_power_of_two(odd, tokenizer("word_bpe_49k.json"))
    packing.write_buckets(packed, f"file://{tmp_path}/packed")
    folders = {p.name for p in (tmp_path / "packed").glob("length=*")}
    assert folders == {f"length={r[0]}" for r in packed.select("length").distinct().collect()}
    again = spark.read.parquet(f"file://{tmp_path}/packed")
    key = lambda df: sorted((str(r["doc_id"]), r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(again) == key(packed)


def test_packing_of_random_strings():
    lib, rng = library("word_bpe_49k.json"), random.Random(5)
    parts = [" ", "\n", "a", "Word", "É", "é", "12", ".", ",", "'s", "'", "***", " ", "<|endoftext|>", "İ", "日", "ß", "ñandú"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for kind in (pa.string(), pa.large_string()):
        ids, totals = packing.encode_texts(pa.array(["dropped", *texts], kind).slice(1), tokenizer("word_bpe_49k.json"), 2)
        assert len(totals) == len(texts) and totals.sum() == len(ids)
        for t, part in zip(texts, np.split(ids, np.cumsum(totals))):
            assert part.tolist() == lib.encode(t, add_special_tokens=False).ids + [2], t


def test_punctuation_stands_apart_from_the_word_that_it_ends():
    texts = ["a. b,,; c.d e", "é! ñ?? ß. ÷. À.", "", ".a", "x.", "* y* .", "<|x|> z|"]
    found = packing.apart(pa.array(["zz", *texts]).slice(1)).to_pylist()
    assert found == ["a . b ,,; c.d e", "é ! ñ ?? ß. ÷. À.", "", ".a", "x .", "* y * .", "<|x|> z |"]
    assert packing.apart(pa.array([], pa.string())).to_pylist() == []
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 3)), pa.array(["x" * 5, None, "y" * 40])], names=["i", "t"]) for a in (0, 3, 6)]
    groups = list(packing.by_bytes(iter([batches[0].slice(0, 0), *batches])))
    assert [x for ids, _ in groups for x in ids.to_pylist()] == list(range(9)) and all(len(a) == len(b) for a, b in groups)


def test_pieces_cover_each_text_in_order():
    totals = np.array([1, 4096, 4097, 10_000, 3])
    row, start, length = packing.pieces_of(totals, 4096)
    for i, n in enumerate(totals):
        parts = list(zip(start[row == i].tolist(), length[row == i].tolist()))
        assert [m for _, m in parts] == packing.split_lengths(int(n), 4096)
        assert [a for a, _ in parts] == [sum(m for _, m in parts[:k]) for k in range(len(parts))]


def test_split_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        parts = packing.split_lengths(n, 4096)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts)


# Decontamination, against all windows.


def brute_hits(text, items):
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, body in items:
        other = ALNUM.findall((body or "").translate(LOWER))
        k = min(10, len(other))
        windows = {tuple(other[i : i + k]) for i in range(len(other) - k + 1)} if other else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(name))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_decontamination_equals_all_windows(spark, limit):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(30)] + [(40, None), (41, "!!"), (None, "w1 w2"), (3, text(12))]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        body = items[rng.randrange(30)][1].split()
        a = rng.randrange(len(body))
        parts.insert(1, " ".join(body[a : a + rng.randint(5, 25)]).upper())
        docs.append((i, ", ".join(parts)))
    docs += [(200, None), (201, ""), (202, "w0 " * 5000), (203, docs[0][1]), (203, docs[0][1]), (None, docs[1][1])]
    frame = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None]
    found = decontam.decontaminate(frame, bench, broadcast_bytes=limit).drop("spans")
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted((str(i), *brute_hits(t, known)) for i, t in docs)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == expected
    clean = decontam.drop_contaminated(frame, bench, broadcast_bytes=limit)
    assert clean.columns == frame.columns
    assert clean.count() == sum(not e[-1] for e in expected)
    assert {r["n_items"] for r in decontam.decontaminate(frame, bench.limit(0), broadcast_bytes=limit).collect()} == {0}
    assert decontam.decontaminate(frame.limit(0), bench, broadcast_bytes=limit).collect() == []


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_decontamination_beside_columns_of_any_name(spark, limit):
    names = ["doc_id", "text", "at_", "near_", "decontam_", "a.b", "key_", "row_", "n_hit", "r_"]
    passage = " ".join(f"w{i}" for i in range(14))
    data = [(i, t, *"abcdefgh") for i, t in ((1, passage), (2, "clean"), (3, None))]
    frame = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[2:]))
    bench = spark.createDataFrame([("x", passage, 1)], "item_id string, text string, `win` int")
    found = {r["doc_id"]: tuple(r)[1:4] for r in decontam.decontaminate(frame, bench, broadcast_bytes=limit).collect()}
    assert found == {1: (14, 14, 1), 2: (1, 0, 0), 3: (0, 0, 0)}
    kept = decontam.drop_contaminated(frame, bench, broadcast_bytes=limit)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == data[1:]


def test_a_passage_that_many_documents_share(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i % 3}") for i in range(60)] + [(100 + i, passage) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "x " + passage)], "item_id long, text string")
    rows = [decontam.decontaminate(docs, bench, broadcast_bytes=n).collect() for n in (decontam.BROADCAST_BYTES, -1)]
    assert sorted(rows[0]) == sorted(rows[1]) and all(r["n_hit"] == 12 and r["n_items"] == 2 for r in rows[0])


def test_decontamination_query(spark, tiny):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    docs = docs_of(spark, tiny)
    for r in op4_decontamination(spark, tiny).collect():
        assert tuple(r[1:]) == brute_hits(docs[r["doc_id"]]["text"], items)


# Language identification, against coding byte by byte.


def plain_code_length(texts, alphabet, text):
    """Method C with exclusion by renormalising, from counts held in dictionaries."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
    pad = ["^"] * 3
    for raw in texts:
        s = pad + list(raw)
        for i in range(3, len(s)):
            for k in range(4):
                counts[k][tuple(s[i - k : i])][s[i]] += 1

    def prob(context, sym):
        if context is None:
            return 1 / 256
        seen = counts[len(context)].get(tuple(context))
        lower = None if not context else context[1:]
        if not seen:
            return prob(lower, sym)
        n, q = sum(seen.values()), len(seen)
        rest = 1 - sum(prob(lower, t) for t in seen)
        if rest <= 1e-12:
            return seen[sym] / n
        return seen[sym] / (n + q) if sym in seen else q / (n + q) * prob(lower, sym) / rest

    s = pad + [c if c in alphabet else "?" for c in text]
    bits = 0.0
    for i in range(3, len(s)):
        context = s[i - 3 : i]
        bits -= math.log2(prob(context, s[i]))
    return bits


def test_code_lengths_equal_plain_coding():
    texts = {"a": [b"banana bandana", b"ban the banana"], "b": ["où est la bibliothèque".encode(), b"la banane"], "c": []}
    model = langid.fit(texts)
    alphabet = {b for group in texts.values() for raw in group for b in raw}
    probes = [b"", b"banana", "la bibliothèque".encode(), b"zzz ban \xff\x00 q", b"b"]
    got = model.code_lengths(probes)
    for i, probe in enumerate(probes):
        for k, language in enumerate(model.languages):
            assert got[i, k] == pytest.approx(plain_code_length(texts[language], alphabet, probe), rel=1e-4, abs=1e-4)


def test_language_query(spark, small, odd):
    found = op2_language_id(spark, small).collect()
    docs = docs_of(spark, small)
    assert len(found) == len(docs)
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in found) == len(held)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    model = langid.fit(langid.training_texts(spark.read.parquet(f"{small}/documents.parquet")))
    by_id = collections.defaultdict(list)
    for r in langid.identify_language(odd, model).collect():
        by_id[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert {i for i in by_id if by_id[i][0] == ("und", 0.0)} == {1, 2, 3, 4}
    assert len(by_id[8]) == 2 and len(by_id[None]) == 1
    assert langid.identify_language(odd.limit(0)).collect() == []
    none = odd.withColumn("lang", odd.lang.substr(9, 9))
    assert langid.training_texts(odd.where("lang is null")) == {} and len(none.collect()) == len(ODD)
    assert {r["lang_pred"] for r in langid.identify_language(odd.where("lang is null")).collect()} == {"und"}


# Quality rules and licenses.


def plain_base(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), failed


def test_quality_rules(spark, small, odd):
    docs = docs_of(spark, small)
    found = op8_quality_rules(spark, small).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r[1:7]) == plain_base(docs[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    passed = [(labels[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = ([k for q, k in passed if q == y] for y in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.35
    expected = sorted((str(i), *plain_base(t)) for i, t, _ in ODD)
    got = rules.quality_rules(odd)
    assert sorted((str(r[0]), *r[1:7]) for r in got.collect()) == expected
    assert rules.quality_rules(odd.limit(0)).collect() == []


def test_distance_is_jensen_shannon():
    p, q = np.array([1, 2, 0, 5]), np.array([0, 3, 3, 1])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert rules.distance(p, q) == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))
    assert rules.distance(p, p) == 0 and rules.distance(p, 0 * p) == 0


def plain_license(text):
    words = ALNUM.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        k = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(k)] == k]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_blocks(text):
    out = []
    for i, line in enumerate((text or "").split("\n")):
        block = set(ALNUM.findall(line.translate(LOWER)))
        for name, body in licenses.TEMPLATES.items():
            template = set(ALNUM.findall(body.translate(LOWER)))
            share = len(block & template) / len(template)
            if share >= licenses.THRESHOLD - 1e-9:
                out.append((i, name, pytest.approx(share)))
    return out


def test_license_scan(spark, small, odd):
    docs = docs_of(spark, small)
    for r in op10_license_scan(spark, small).collect():
        assert tuple(r[1:6]) == plain_license(docs[r["doc_id"]]["text"])
    rng = random.Random(2)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts = list(licenses.TEMPLATES.values()) + ["MIT-License, cc-by cc by", "gnu general public license apache license"]
    for t in list(licenses.TEMPLATES.values()):
        words = t.split()
        for drop in (1, 2, 4):
            kept = [w for w in words if rng.random() > drop / len(words)]
            rng.shuffle(kept)
            texts.append("x y\n" + " ".join(kept + rng.sample(pool, 5)) + "\nz")
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    for r in licenses.license_scan(frame).collect():
        t = texts[r["doc_id"]]
        assert tuple(r[1:6]) == plain_license(t)
        blocks = plain_blocks(t)
        assert sorted((b["line"], b["template"], b["containment"]) for b in r["blocks"]) == sorted(blocks, key=lambda b: b[:2])
        assert set(r["labels"].split(",")) - {""} == set(r["base_labels"].split(",")) - {""} | {b[1] for b in blocks}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert sorted((str(r[0]), *r[1:6]) for r in licenses.license_scan(odd).collect()) == sorted(
        (str(i), *plain_license(t)) for i, t, _ in ODD
    )
    assert licenses.license_scan(odd.limit(0)).collect() == []


def best_window(text, body):
    """The largest containment of all runs of words that are lines or within the reach, by brute force."""
    template, reach = set(ALNUM.findall(body.translate(LOWER))), licenses.REACH * len(ALNUM.findall(body.translate(LOWER)))
    words = ALNUM.findall(text.translate(LOWER))
    runs = [words[i : i + reach] for i in range(len(words))] + [ALNUM.findall(x.translate(LOWER)) for x in text.split("\n")]
    best = max((len(template & set(r)) / len(template) for r in runs), default=0)
    return best if best >= licenses.THRESHOLD - 1e-9 else 0


def test_license_notices_that_are_wrapped(spark):
    texts, names = [], []
    for width in (24, 40, 60, 80):
        for mark in ("", " * ", "// "):
            for name, body in licenses.TEMPLATES.items():
                wrapped = textwrap.fill(body, width, initial_indent=mark, subsequent_indent=mark)
                texts.append(f"{mark}Copyright someone\n{mark}\n{wrapped}\n{mark}\n\nint main")
                names.append(name)
    rng = random.Random(3)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts += ["\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(30)) for _ in range(60)]
    bsd = licenses.TEMPLATES["bsd-notice"].split()
    texts.append("\n".join(w + " other" * 4 for w in bsd))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    for i, name in enumerate(names):
        assert name in rows[i]["labels"].split(",") and rows[i]["score"] == 1
        assert max(b["containment"] for b in rows[i]["blocks"] if b["template"] == name) == 1
    for i, text in enumerate(texts):
        best = {name: best_window(text, body) for name, body in licenses.TEMPLATES.items()}
        found = {name: max((b["containment"] for b in rows[i]["blocks"] if b["template"] == name), default=0) for name in best}
        assert found == best and rows[i]["score"] == (1 if rows[i]["n_base"] else max(best.values()))
        for b in rows[i]["blocks"]:
            part = set(ALNUM.findall("\n".join(text.split("\n")[b["line"] : b["line"] + b["lines"]]).translate(LOWER)))
            template = set(ALNUM.findall(licenses.TEMPLATES[b["template"]].translate(LOWER)))
            assert licenses.THRESHOLD - 1e-9 <= b["containment"] <= len(part & template) / len(template)
    assert rows[len(texts) - 1]["labels"] == ""


def test_wrapped_notices_equal_the_sql(spark):
    rng = random.Random(4)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts = [textwrap.fill(body, width) for body in licenses.TEMPLATES.values() for width in (12, 30, 80)]
    texts += ["\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(30)) for _ in range(40)]
    texts += ["\n\n".join(rng.sample(texts, 3)) for _ in range(30)] + [None, "", "apache license " * 3000]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("blocks")
    assert compare(found, db, ORACLE_SQL["op10_license_scan"]) == len(texts)

"""Each operator beside a brute-force version, and on the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import SF, rows_of, rows_of_sql
from tests.llm import data
from tidelog.llm import chat, licenses, mixing, near_dedup, pieces, quality, queries, secrets, suffix_dedup, token_files
from tidelog.llm.exact_dedup import exact_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(queries.ORACLES[name])


BY_NAME = {
    "licenses": licenses.scan_licenses, "mixing": mixing.mix_sources, "quality": quality.judge_quality, "secrets": secrets.scan_secrets, "exact": exact_dedup,
    "suffix": suffix_dedup.repeated_spans, "near": near_dedup.near_dedup,
    "pieces": lambda d: pieces.encode_pieces(d, queries.tokenizer_path("piece_bpe_32k.model")),
    "tokens": lambda d: token_files.token_files(d, queries.tokenizer_path("byte_bpe_50k.json"))}


@pytest.mark.parametrize("name", sorted(BY_NAME))
def test_empty_table_and_null_ids(spark, name):
    assert BY_NAME[name](data.empty(spark)).count() == 0
    assert BY_NAME[name](data.null_id(spark)).count() == 2


def test_licence_sequences(spark):
    rows = [(1, "This is free. Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."), (2, "Licensed under CC BY 4.0"), (3, None),
            (4, "Redistribution and use in source and binary forms, with or without modification, are permitted: other words.\nRedistributions of source code must retain the above copyright notice.\n"
                "Redistributions in binary form must reproduce the above copyright notice."), (5, "The MIT license is not granted by this sentence")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["CC-BY-4.0"], 3: [], 4: ["BSD-2-Clause"], 5: []}


# How notices of these licences read.
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
                  "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software is distributed on an AS IS basis.",
    "MIT": 'MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
           "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
           "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "BSD-2-Clause": "Copyright (c) 2020, Some One\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
                    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
                    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
                    "provided with the distribution.",
    "ISC": "Copyright (c) 2020 Some One\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
           "permission notice appear in all copies.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
                        "of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
                        "of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
                         "version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + ("\n3. Neither the name of Some Firm, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
                                                     "written permission.").replace(", Inc.", "")


@pytest.mark.parametrize("marker", ["", "# ", " * "])
def test_notices_wrapped_or_not(spark, marker):
    import textwrap

    wrap = lambda t, width: "\n".join(marker + line for part in t.split("\n") for line in (textwrap.wrap(part, width) or [""]))
    rows = [(f"{name} {width}", f"{wrap('Before it.', 72)}\n{marker}\n{wrap(text, width)}\n{marker}\nint main() {{}}") for name, text in NOTICES.items() for width in (72, 40, 5000)]
    rows += [(f"{name} all", text) for name, text in NOTICES.items()]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: [k.split(" ")[0]] for k, _ in rows}


def test_long_texts_of_many_matches_take_seconds(spark):
    import random
    import time

    rnd = random.Random(1)
    keys = " ".join(f"{rnd.getrandbits(192):048x}" for _ in range(4_000))
    df = spark.createDataFrame([(1, keys)], "doc_id long, text string")
    began = time.time()
    spans = secrets.scan_secrets(df).first()["spans"]
    assert time.time() - began < 120 and len(spans) == 4_000 and all(s["end"] - s["start"] == 48 for s in spans) and spans[-1]["end"] == len(keys)
    df = spark.createDataFrame([(1, (NOTICES["BSD-2-Clause"] + "\n\n") * 1000)], "doc_id long, text string")
    began = time.time()
    row = licenses.scan_licenses(df).first()
    assert time.time() - began < 120 and len(row["sentence_ids"]) == 3000 and row["licenses"] == ["BSD-2-Clause"]


def test_other_sentences_bring_their_own_hint(spark):
    df = spark.createDataFrame([(1, "Nothing here.\nUse it as you like!")], "doc_id long, text string")
    assert licenses.scan_licenses(df, {"use it as you like": "own.free"}, (("Own", ("own.free",)),)).first()["licenses"] == ["Own"]


def test_mixture_meets_its_targets(spark, docs):
    shown = mixing.mix_sources(docs, max_repeat=2.0, block_tokens=500).collect()
    assert {r["doc_id"] for r in shown} == {r["doc_id"] for r in docs.collect()}  # nothing is left out
    tokens, once = Counter(), Counter()
    for r in shown:
        tokens[r["source"]] += r["n_tokens"]
        once[r["source"]] += r["n_tokens"] * (r["epoch"] == 1)
    assert max(tokens[s] / once[s] for s in tokens) <= 2.0
    p = [tokens[s] / sum(tokens.values()) for s in tokens]
    before = [once[s] / sum(once.values()) for s in once]
    entropy = lambda xs: -sum(x * math.log(x) for x in xs)
    assert entropy(before) < entropy(p) <= math.log(3)


def test_small_sources_have_their_partial_epoch(spark):
    """Of one block each at the production size: tokens are within one document of the plan's, in the pipeline too."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows = [(k, "w " * (5 + k % 20), None, "big" if k < 3000 else "mid" if k < 3300 else "small") for k in range(3360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    count = F.regexp_count("text", F.lit(mixing.WORD)).cast("long")
    totals = docs.groupBy("source").agg(F.sum(count).alias("tokens"))
    plan = {r["source"]: r["whole"] * r["tokens"] + r["rest"] for r in mixing.plan_mixture(totals).collect()}
    assert plan["small"] > totals.where("source = 'small'").first()["tokens"]
    for shown in (mixing.mix_sources(docs, split=True), corpus_pipeline.source_mixture(spark, docs, "").withColumn("n_tokens", count)):
        got = {r["source"]: r["n"] for r in shown.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        assert all(0 <= plan[s] - got[s] < 24 for s in plan), (plan, got)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok, want, at = Tokenizer.from_file(path), [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for size in (1 << 12, 1 << 22):
        got = token_files.token_files(docs, path, shard_bytes=size).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok, encoder, rnd = Tokenizer.from_file(path), token_files.PieceEncoder(path), random.Random(3)
    monkeypatch.setattr(token_files, "REMEMBERED", 400)  # so that pieces are forgotten in between
    bits = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "the", "Word", "'s", "'", "'ll", "S", "don't", "\u00e9", "\u00fc", "\u65e5\u672c", "\u3002", "\u201c", "\u2019", "1", "42", "\u00bd", "\u0663", ".", ",", "_", "(",
            "<|endoftext|>", "<|", "\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\x0b", "\x00", "\U0001f600", "e\u0301", "\u200b"]
    for _ in range(12):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None, ""]
        want = [x.ids for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        ids, n = encoder.encode(pa.array(texts))
        assert ids.tolist() == [k for x in want for k in x] and n.tolist() == list(map(len, want))
        symbols, starts, rules, n = token_files.compress(*encoder.pieces(pa.array(texts)), encoder.vocabulary, 0)
        lengths = token_files.lengths_of(rules, encoder.vocabulary)
        assert token_files.expand_all(symbols, rules, encoder.vocabulary, lengths)[0].tolist() == [k for x in want for k in [*x, 0]]
        for k in range(0, 402, 40):
            end = starts[k + 1] if k + 1 < starts.size else symbols.size
            assert token_files.expand(symbols[starts[k] : end], rules, encoder.vocabulary, lengths).tolist() == [*want[k], 0]


def test_a_word_is_encoded_once_whatever_mark_or_line_feed_follows():
    encoder = token_files.PieceEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    texts = [f"x {a}{m}{b}{e}" for a in ("alpha", "beta", "gamma") for b in ("Delta", "Eta", "Theta") for m in (".\n", ",\n", "\n") for e in (" alpha", ".", "")]
    ids, n = encoder.encode(pa.array(texts))
    assert ids.tolist() == [k for t in texts for k in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert len(encoder.known) == 10  # x, three words behind a space, three behind a line feed, comma, full stop, line feed


def test_no_frequent_pair_is_left_and_weights_count_repeated_documents():
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(1, 9, rnd.integers(1, 30)) for _ in range(60)]
    weights = rnd.integers(1, 5, 60)
    ids, starts = np.concatenate(docs).astype(np.uint32), np.cumsum([0, *map(len, docs[:-1])])
    for w in (None, weights):
        symbols, at, rules = token_files.repair(ids, starts, 10, weights=w)
        lengths = token_files.lengths_of(rules, 10)
        ends = np.append(at[1:], symbols.size)
        assert all((token_files.expand(symbols[a:b], rules, 10, lengths) == d).all() for a, b, d in zip(at, ends, docs, strict=True))
        left = {}
        for a, b, k in zip(at, ends, np.ones(60, int) if w is None else w, strict=True):
            last = None
            for pair in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist(), strict=True):
                last = None if pair == last and pair[0] == pair[1] else pair  # of a run, every other
                left[last] = left.get(last, 0) + int(k)
        left.pop(None, None)
        assert max(left.values(), default=0) < token_files.LEAST_PAIRS


def test_grammar_compresses_and_gives_single_documents():
    ids = np.array(([5, 6, 7, 8] * 50 + [0]) * 4 + [1, 2, 3, 0], np.uint32)
    starts = np.array([0, 201, 402, 603, 804])
    symbols, at, rules = token_files.repair(ids, starts, 10)
    row = {"symbols": symbols.tobytes(), "rules": rules.tobytes(), "starts": at.astype(np.int64).tobytes(), "lengths": token_files.lengths_of(rules, 10).astype(np.uint32).tobytes(), "vocabulary": 10}
    assert symbols.size < ids.size / 8
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], ids.size], strict=True)):
        assert (token_files.read_document(row, k) == ids[a:b]).all()
    assert token_files.lengths_of(rules, 10).max() >= 16


def test_quality_counts(docs):
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((r["doc_id"], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.judge_quality(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_outliers_do_not_hide_themselves(spark):
    """A tenth of the rows lie far off; the estimate rests on the others, so they are found, and few others are."""
    import random

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    rows = [(k, " ".join(word(rnd.randint(20, 30) if k % 10 == 0 else rnd.randint(3, 7)) for _ in range(90)), "en", "web") for k in range(400)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k] for k in range(0, 400, 10)) and all(got[k] for k in range(400) if k % 10)


def test_outlier_of_each_dimension(spark):
    """In a group of plain texts, one far off in one dimension only."""
    import random

    rnd = random.Random(6)
    word = lambda a, b: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(a, b)))
    text = lambda a=3, b=7: "\n".join(" ".join(word(a, b) for _ in range(9)) for _ in range(12))
    rows = [(k, text(), "en", "web") for k in range(300)]
    passage = " ".join(word(3, 7) for _ in range(25))
    rows += [(1000, text(14, 18), "en", "web"), (1001, " ".join(w + "#" for w in text().split()), "en", "web"),
             (1002, text() + "\nab cd" * 40, "en", "web"), (1003, f"{passage} {passage} {text()}", "en", "web"),
             (1004, "\n".join([text()] + [c for c in "abcdefghij"] * 9), "en", "web")]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k]["base_failed"] for k in range(1000, 1005))
    assert not any(got[k]["kept"] for k in range(1000, 1005)) and sum(got[k]["kept"] for k in range(300)) > 294


def test_secrets(spark):
    rows = [(1, "😀 api_key = 'abcdef123' and Token:short1x password: abc"), (2, "AKIA" + "A1B2" * 4 + " AKIA12 " + "0123456789abcdef" * 2), (3, None), (4, "x9Kq2LmZ8vBn4RtY7wPc1D"),
            (5, "123e4567-e89b-12d3-a456-426614174000 1111111111aaaaaaaaaa1111"), (6, "")]
    got = {r["doc_id"]: [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("assign", 2, 22), ("assign", 28, 41)]
    assert got[2] == [("access", 0, 20), ("hex", 28, 60)]
    assert got[3] == [] and got[6] == [] and got[4] == [("entropy", 0, 22)]
    assert got[5] == [("hex", 37, 61)]  # a UUID is on the allow-list, and few different characters are not random


def test_window_entropy(spark):
    s = "aabbccdd0123456789efghijklmnaaaaaaaaaaaaaaaaaaaa"
    want = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
    from pyspark.sql import functions as F

    assert spark.range(1).select(secrets.peak_entropy(F.lit(s))).first()[0] == pytest.approx(want)


def test_pieces_have_the_best_score(spark, docs, texts):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    m, sp = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_pieces(docs, path).collect():
        ids = r["ids"]
        assert r["round_trip"] and r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert m.decode(ids) == m.plain(texts[r["doc_id"]])
    rest = "▁the▁quick▁brown▁foxes"
    best = [(0.0, [])] + [None] * len(rest)
    for e in range(1, len(rest) + 1):
        best[e] = max((best[b][0] + m.pieces[rest[b:e]][0], [*best[b][1], m.pieces[rest[b:e]][1]]) for b in range(e) if best[b] and rest[b:e] in m.pieces)
    got = m.encode("the quick brown foxes")
    assert sum(sp.get_score(i) for i in got) == pytest.approx(best[-1][0], rel=1e-6)


def test_pieces_are_those_of_the_library(spark, docs, texts):
    import random

    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp, m, rnd = sentencepiece.SentencePieceProcessor(model_file=path), pieces.encoder(path), random.Random(2)
    for r in pieces.encode_pieces(docs, path).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]])
    some = ["The government of the quick brown foxes", "", "aaaa" * 40, "a" * 3001, " x  y\n\n z\t", "\x00", "ünïcode 日本語 text\nline", "😀😀 mixed 123", "▁ ▁▁a", "e\u0301 ﬁ"]
    some += ["".join(rnd.choice("aeinorst hELdu, .\n😀é_0") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    want = [sp.encode(t) for t in some]
    ids, n = m.encode_many(some)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == want
    assert [m.encode(t) for t in some] == want


def test_streaming_and_side_by_side_agree():
    m = pieces.model(queries.tokenizer_path("piece_bpe_32k.model"))
    some = ["hello world", "a" * 300, "ünïcode 日本語 text\nline", "x", "", "😀😀 mixed 123", "tab\tand  spaces "]
    ids, n = m.encode_many(some)
    at = 0
    for text, k in zip(some, n, strict=True):
        assert ids[at : at + k].tolist() == m.encode(text)
        at += k


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be <brief> ~0")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "w " * 40 + "[INST]") for k in range(1, 30)]
    turns += [(2, 0, "user", None), (2, 1, None, "x"), (None, None, "assistant", "<|end|>"), (3, 0, "assistant", "long " * 900)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.format_chat(df)
    got = windows.collect()
    assert all(r["tokens"] <= chat.BUDGET for r in got if r["conv_id"] == 1) and len([r for r in got if r["conv_id"] == 1]) > 2
    assert all(r["formatted"].startswith("<|system|>") for r in got if r["conv_id"] == 1)
    assert not any("[INST]" in r["formatted"] for r in got)
    for r in chat.digests(windows).collect():
        own = [t for t in turns if t[0] == r["conv_id"]]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own))
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


def test_chat_windows_keep_the_budget(spark):
    """Random conversations, some with large system turns, equal turn numbers and repeated rows: only a turn that is too large by itself passes the budget."""
    import random

    rnd, rows = random.Random(8), [(-1, k, "system" if k == 0 else "user" if k % 2 else "assistant", "w " * n) for k, n in enumerate((190, 4, 189, 189, 20))]
    for conv in range(120):
        big = rnd.choice((30, 190, 400, 600))
        for k in range(rnd.randint(1, 25)):
            role = "system" if k == 0 and conv % 2 else rnd.choice(("user", "assistant"))
            rows.append((conv, k // 2 if conv % 5 == 0 else k, role, "w " * rnd.randint(0, big)))
    rows += rows[-3:]
    windows = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = windows.collect()
    for r in got:
        assert r["tokens"] <= chat.BUDGET or (r["n_own"] == 1 and r["formatted"].split("<|end|>")[-2].count("w ") >= chat.BUDGET), r
    assert len(got) > 400 and any(r["n_context"] for r in got)
    back = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1], t[2], t[3]))
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert back[conv]["n_turns"] == len(own) and (back[conv]["loss_chars"], back[conv]["loss_sha256"]) == (len(loss), sha(loss))


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_copies(spark, docs, keep, collide):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(fold(r["text"] or ""), []).append(r["doc_id"])
    pick = max if keep == "max" else min
    want = sorted((r["doc_id"], pick(g), len(g), r["doc_id"] == pick(g), sha(fold(r["text"] or ""))) for r in rows for g in [groups[fold(r["text"] or "")]])
    digest = (lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 1 * 2 if collide else 64))) if collide else None
    assert sorted(map(tuple, exact_dedup(docs, keep=keep, digest=digest).collect())) == want


def test_repeated_spans(spark, docs):
    rows, starts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}, {}
    for k in sorted(rows):
        for i in range(len(rows[k]) - 49):
            starts.setdefault(rows[k][i : i + 50], k)
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(docs).collect()}
    assert set(got) == set(rows) and sum(r["n_removed"] for r in got.values()) > 1000
    for k, b in rows.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if starts[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(b), sum(gone), spans, sha(kept))


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(spark, docs, texts, size):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(fold(t))
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    got = near_dedup.near_dedup(docs, shingle=size).collect()
    assert {tuple(r) for r in got} == {(k, len(s), root(k), root(k) == k) for k, s in sets.items()}
    assert len(got) == docs.count()


def test_long_chains_are_one_component(spark):
    import random

    from tidelog.llm.common import Scratch

    ids = list(range(1, 1001))
    random.Random(1).shuffle(ids)
    tail = [*range(2002, 2102), 2001]
    links = [*zip(ids, ids[1:]), *zip(tail, tail[1:])]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark), "t").collect()
    assert {(r["id"], r["label"]) for r in got} == {(k, 1) for k in ids} | {(k, 2001) for k in tail}
    assert len(got) == len(ids) + len(tail)


@pytest.mark.parametrize("n_groups", [3, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_groups_join_broadcast_or_salted(spark, n_groups, how):
    """Both ways of joining a table of groups give the rows of a plain join, with a hot key and keys that only one side has."""
    from tidelog.llm.common import join_groups

    rows = spark.range(300).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('k', id % 5)) as source")
    groups = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "source string, weight int")
    want = sorted(map(tuple, rows.join(groups, "source", how).select("doc_id", "source", "weight").collect()), key=str)
    got = join_groups(rows, groups, ["source"], n_groups, how=how)
    assert "salt" not in got.columns
    assert sorted(map(tuple, got.select("doc_id", "source", "weight").collect()), key=str) == want

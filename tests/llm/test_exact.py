"""Operators with one right result, against brute force."""

import collections
import hashlib
import io
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontamination, token_files
from keyloom.llm import jaccard_join as module
from keyloom.llm.components import components
from keyloom.llm.decontamination import leaks
from keyloom.llm.jaccard_join import jaccard_join
from keyloom.llm.line_dedup import dedup_lines
from keyloom.llm.packing import pack, places, plan
from keyloom.llm.pii import counted, estimate, find_personal_data, listed
from keyloom.llm.quality import judge_quality
from keyloom.llm.queries import op6_suffix_dedup
from keyloom.llm.suffix_dedup import remove_repeats, sort_windows
from keyloom.llm.tokens import Encoder

SPACES = " \t\n\x0b\x0c\r"
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def last(i):
    return 2**63 - 1 if i is None else i


def key(line):
    return line.strip(SPACES).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, rows, batches):
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(last(i), owner.get(key(line), 2**63))
    expected = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == last(i)]
        expected.append((last(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(last(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs, batches=batches).collect()]
    assert sorted(got) == sorted(expected)


def test_line_dedup_sql(spark, rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from keyloom.llm import queries

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(queries.ORACLE_SQL["op2_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) == len(rows)


def words(text):
    return (text or "").encode().lower().split()


def test_jaccard_join(docs, rows):
    sets = [set(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else set() for _, t in rows]
    label = [last(i) for i, _ in rows]
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and (100 * len(x & y) >= 80 * len(x | y)):
                    label[a] = label[b] = min(label[a], label[b])
    got = [(last(r.doc_id), r.n_shingles, last(r.component_id)) for r in jaccard_join(docs).collect()]
    assert sorted(got) == sorted((last(i), len(s), c) for (i, _), s, c in zip(rows, sets, label))


def near(text, k):
    """A near copy: one word is another."""
    w = text.split()
    w[k] = f"other{k}"
    return " ".join(w)


def test_jaccard_join_of_null_and_repeated_ids(spark):
    r = random.Random(8)
    a, b, c = (" ".join(f"{x}{r.randint(1, 10**6)}" for _ in range(100)) for x in "abc")
    data = [(5, a), (9, b), (None, near(a, 3)), (None, near(b, 3)), (7, c), (7, near(a, 4)), (8, near(b, 4)), (8, near(c, 4)), (None, c + " d")]
    data += [(None, "no id here at all one"), (None, "no id here at all two"), (None, "no id here at all one")]
    out = jaccard_join(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).select("doc_id", "component_id").collect()
    expected = [(5, 5), (9, 8), (None, 5), (None, 8), (7, 7), (7, 5), (8, 8), (8, 7), (None, 7), (None, None), (None, None), (None, None)]
    assert sorted((last(r.doc_id), last(r.component_id)) for r in out) == sorted((last(i), last(k)) for i, k in expected)


def test_jaccard_join_counts_all_links(spark, monkeypatch):
    r = random.Random(9)
    base = [" ".join(f"{x}{r.randint(1, 10**6)}" for _ in range(120)) for x in "abc"]
    texts = [base[0], base[0]] + [near(base[0], k) for k in range(20, 60)] + [near(near(near(base[1], 10), 50), 90), base[1], near(base[1], 30), base[2], ""]
    texts += [" ".join(base[2].split()[k : k + 100]) for k in range(0, 20, 4)] + [near(base[0], 25)]
    sets = [set(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(words, texts)]
    links = [sum(len({*map(frozenset, (x, y))}) == 2 and 100 * len(x & y) >= 80 * len(x | y) for y in {frozenset(y) for y in sets}) for x in sets]
    assert max(links) == 40 and len(set(links)) > 4
    out = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for part in (2048, 7):  # in one part, and in several
        monkeypatch.setattr(module, "PART_SETS", part)
        assert [r.n_links for r in jaccard_join(out).orderBy("doc_id").collect()] == links


def test_shared_counts():
    r = np.random.default_rng(3)
    x, y = ([np.unique(r.integers(0, most, n).astype(np.uint64)) for most, n in zip(r.integers(20, 9000, 90), r.integers(1, 300, 90))] for _ in "xy")
    assert module.shared_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(50)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)]
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}


def test_remove_repeats(docs, rows):
    data = [(last(i), (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + 400] for _, b in data for p in range(len(b) - 399))
    expected = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        expected.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone) if not g)))
    got = [(last(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect()]
    assert sorted(got) == sorted(expected) and sum(x[2] for x in expected) > 5000


def test_planted_passages(spark, tmp_path):
    """Through the query: of passages of over 50 words, each in two texts, those of 400 bytes go whole; shorter ones and clean texts stay."""
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(2, 10))) for _ in range(n))
    passages = [prose(120)[:399], prose(120)[:400], *(prose(r.randint(51, 110)) for _ in range(20))]
    texts, expected = [], []
    for passage in passages:
        for mark in "#$":
            before, after = prose(50) + mark, mark + prose(50)
            gone = len(passage) >= 400
            texts.append(before + passage + after)
            expected.append((len(texts[-1]), gone * len(passage), int(gone), before + after if gone else texts[-1]))
    clean = [prose(200) for _ in range(40)]
    texts, expected = texts + clean, expected + [(len(t), 0, 0, t) for t in clean]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in op6_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(i, *x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for i, x in enumerate(expected)]
    assert {len(p) >= 400 for p in passages[2:]} == {False, True}


def test_sort_windows():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(600)) + b"a" * 600 + b"ab" * 300, np.uint8).reshape(3, 600)
    row, at = np.repeat(np.arange(3), 150), np.tile(np.arange(150), 3)
    order, classes = sort_windows(data, row, at)
    windows = [data[row[k], at[k] : at[k] + 400].tobytes() for k in order]
    assert windows == sorted(windows)
    assert [a == b for a, b in zip(windows, windows[1:])] == (np.diff(classes) == 0).tolist()


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    valid = {"email": lambda h, d: True, "ip": lambda h, d: all(int(x) <= 255 for x in h.split(".")), "card": lambda h, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda h, d: 9 <= len(d) <= 15}
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if valid[k](m.group(), re.sub("[^0-9]", "", m.group()))]


ODD = [
    "a@b.c_d@e.f x@y.z@w.v 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.00255 99999.1.1.1", "é +1 (234) 555-1234 +12 +123456789 +1234567890123456 4111 1111 1111 1111 4111-1111-1111-1112 x4111111111111111y " + "1" * 5000 + " " + "4 " * 4000,
    "a" * 20000 + "@" + "b" * 10 + ".c@d.e", "mail joe (at) example (dot) com or call 234-555-6789", "😀a@b.co 😀 1.1.1.1", "+1 2\n3456789 a@b. a@b..c a@.b @c.d", "", None,
]


def test_base_spans_stay(spark, docs, rows):
    more = list(enumerate(ODD, 1000))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = find_personal_data(both).select("doc_id", *[counted("base", k) for k in ("email", "ip", "card", "phone")], listed("base").alias("base"), listed("spans").alias("spans")).collect()
    expected = sorted((last(i), ",".join("%s:%d:%d" % s for s in base_spans(t or ""))) for i, t in rows + more)
    assert sorted((last(r.doc_id), r.base) for r in out) == expected
    assert all(set(r.base.split(",")) - {""} <= set(r.spans.split(",")) for r in out)
    assert all(r.n_email == r.base.count("email:") and r.n_phone == r.base.count("phone:") for r in out)


def test_secrets_are_found_by_the_method_alone(spark):
    r = random.Random(5)
    key = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    say = lambda n: " ".join("".join(r.choices("bcdfgklmnprst", k=r.randint(2, 9))) for _ in range(n))
    data, planted = [], {}
    for i in range(300):
        secret = (f'token = "{key(40)}"', f"password={key(18)}", "AKIA" + "".join(r.choices("ABCDEFGHJK234567", k=16)), "", say(1) * 6, f"commit {key(12)} v1")[i % 6]
        text = f"😀 {say(20)} {secret} {say(20)} a{i}@mail.example.com"
        value = re.search(r"[0-9a-f]{40}|(?<==)[0-9a-f]{18}|AKIA\w+", secret)
        if value:
            planted[i] = (text.index(value[0]), text.index(value[0]) + len(value[0]))
        data.append((i, text))
    out = {x.doc_id: x for x in find_personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    added = {i: [(s.start, s.end) for s in x.spans if s.k == 4] for i, x in out.items()}
    assert all(added[i] == [span] for i, span in planted.items()) and not any(added[i] for i in out if i not in planted)
    assert all(len(x.base) == 1 and len(x.spans) == 1 + len(added[i]) for i, x in out.items())


def test_spans_of_one_text_may_be_many(spark):
    text = "é " + " ".join(f"u{k}@m.example.com +1 (234) 555-{1000 + k}" for k in range(700))
    out = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.k, s.start, s.end) for s in out.base] == sorted(((0, 1, 2, 3)[("email", "ip", "card", "phone").index(k)], a, b) for k, a, b in base_spans(text))


def test_votes_are_weighed():
    rows = [(0, (1, 1, 1, 1, 1), 500), (0, (1, 1, 1, 0, 1), 300), (0, (-1, -1, -1, -1, -1), 400), (0, (-1, -1, 1, -1, -1), 300)]
    p = estimate(rows)
    assert p[0, (1, 1, 1, 1, 1)] > 0.95 and p[0, (-1, -1, -1, -1, -1)] < 0.05 and p[0, (-1, -1, 1, -1, -1)] < 0.2


def statistics(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    at = collections.defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(docs, rows):
    out = judge_quality(docs).collect()
    got = [(last(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert sorted(got) == sorted((last(i), *statistics(t)) for i, t in rows)
    assert not any(r.kept for r in out if r.base_failed)


def test_repeated_windows_among_others(spark):
    text = "w1 w27 w9 u1 u2 w22 w103 w97 u3 u4 w1 w27 w9 u5 u6 w22 w103 w97 u7"
    out = judge_quality(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert out.n_repeat_words == 12 == statistics(text)[4]


def test_outliers_are_rejected_and_prose_stays(spark):
    r = random.Random(8)
    clean = [(i, " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(r.randint(60, 300))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(r.choices("abcdefgh", k=5)) + "***$$$" for _ in range(150)), "en", "s") for i in range(30)]
    kept = {x.doc_id: x.kept for x in judge_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(kept[i] for i, *_ in clean) >= 297 and not any(kept[i] for i, *_ in junk)


def item_rows():
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choices("bcdfgklmnprst", k=r.randint(2, 8))) for _ in range(n))
    items = [(k, say(40)) for k in range(6)] + [(6, "only four words here"), (7, ""), (8, None), (None, say(30))]
    halves = lambda t: (" ".join(t.split()[:20]), " ".join(t.split()[20:]))
    docs = [(0, say(80) + " " + items[0][1] + " " + say(50)), (1, halves(items[1][1])[1] + " " + say(30) + " " + halves(items[1][1])[0].upper()), (2, halves(items[2][1])[0] + " " + say(200)), (3, say(300)), (4, "say only FOUR words here now"), (5, None), (6, items[9][1]), (7, items[3][1] + "\n" + items[4][1])]
    return items, docs


@pytest.mark.parametrize("block", [2_000_000, 45])
def test_leaks(spark, block):
    items, docs = item_rows()
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    assert sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in out) == [(0, 0), (1, 1), (4, 6), (6, -1), (7, 3), (7, 4)]
    assert next(r.tiles for r in out if r.doc_id == 1) == 2
    assert all(r.covered_words == r.item_words for r in out)


def test_tiles_along_a_document_are_those_of_its_seeds(monkeypatch):
    r = random.Random(7)
    for _ in range(60):
        item, doc = ([r.choice("ab" if r.random() < 0.8 else "abcdef") for _ in range(r.randint(1, n))] for n in (40, 200))
        found = []
        for listed in (decontamination.LISTED, -1):
            monkeypatch.setattr(decontamination, "LISTED", listed)
            items = decontamination.Items([(1, decontamination.word_hashes(" ".join(item)))])
            found.append(list(items.covered(decontamination.word_hashes(" ".join(doc)), 20)))
            monkeypatch.undo()
        assert found[0] == found[1]


def test_repeated_words_take_no_product_of_memory():
    items = decontamination.Items([(1, decontamination.word_hashes("ha " * 500))])
    assert list(items.covered(decontamination.word_hashes("ha " * 100_000), 60)) == [(0, 500, 1)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_are_the_librarys(path):
    from tokenizers import Tokenizer

    plain, r = Tokenizer.from_file(path), random.Random(1)
    plain.encode_special_tokens = True
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "a", "Z", "é", "9", "1", "½", ".", "!?", "…", "€", "—", "'S", "\r\n", "_", "º"]
    odd = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)] + ["word " * 250_000 + "end"]
    assert [x.tolist() for x in Encoder(path).encode(odd)] == [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_the_librarys(texts, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    odd = ["  a  b", "it's  we'll\tgo 'S x'", "foo<|endoftext|>bar <|endoftext|> x", "é ́ é", "a b c　d", "x\x1cy \x1c z​q", "日本語 テキスト", "trail ", "ΑΣ ΑΣΣ İ", "\r\n\r\n", "a\u0085b", "🎉🎉 ok", "1234 5.6²"]
    all_texts = [t or "" for t in texts] + odd
    encoder = Encoder(path)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(all_texts)] == [e.ids for e in plain.encode_batch(all_texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 16, 17])
def test_token_files_round_trip(bits):
    r = np.random.default_rng(0)
    out, parts = io.BytesIO(), [r.integers(0, 2**bits, n).astype(np.uint32) for n in (0, 1, 5000, 300_000, 7, 4096)]
    writer = token_files.Writer(out, bits)
    for k, ids in enumerate(parts):
        writer.add(k, ids)
    writer.close()
    reader, whole = token_files.Reader(out, len(out.getvalue())), np.concatenate(parts)
    assert reader.counts.tolist() == [len(p) for p in parts]
    for start, n in ((0, len(whole)), (5, 1), (4095, 2), (100_000, 9000), (len(whole) - 1, 1), (7, 0)):
        assert (reader.ids(start, n) == whole[start : start + n]).all()


def test_token_table(docs, rows):
    ids = Encoder(BYTES).encode([t for _, t in rows])
    size = lambda k: len(ids[k]) + 1
    expected = collections.Counter((last(i), size(k), zlib.crc32(np.append(ids[k], 0).astype("<u4").tobytes())) for k, (i, _) in enumerate(rows))
    out = sorted(token_files.token_table(docs, BYTES).collect(), key=lambda r: r.start)
    assert collections.Counter((last(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == expected
    assert [last(r.doc_id) for r in out] == sorted(last(i) for i, _ in rows)
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()


def test_packing(docs, rows):
    ids = [np.append(x, 1).astype("<u4") for x in Encoder(WORDS).encode([t for _, t in rows])]
    expected = collections.Counter((last(i), k // 256, k, len(x[k : k + 256]), zlib.crc32(x[k : k + 256].tobytes())) for (i, _), x in zip(rows, ids) for k in range(0, len(x), 256))
    out = pack(docs, WORDS, capacity=256).collect()
    assert collections.Counter((last(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 256
    assert len(sequences) <= -(-sum(r.length for r in out) // 256) * 1.1 + 1


def test_plan_is_whole_and_tight():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000, 100_000):
        lengths = np.minimum(np.exp(r.normal(6, 1.2, n)).astype(int) + 1, 4096)
        counts = np.bincount(lengths, minlength=4097)
        fillings = plan(counts)
        used = np.zeros(4097, int)
        for often, filling in fillings:
            assert sum(filling) <= 4096
            np.add.at(used, filling, often)
        assert (used == counts).all() and sum(o for o, _ in fillings) <= lengths.sum() / 4096 * 1.02 + 1
        taken = collections.Counter()
        for length, first, ranks, *_ in places(fillings):
            assert taken[length] == first
            taken[length] += ranks
    # The shortest piece is given back for two that fit better: 6+3 leaves 1, 6+2+2 leaves none.
    assert sorted(map(sorted, (f for _, f in plan(np.bincount([6, 3, 2, 2], minlength=11), 10)))) == [[2, 2, 6], [3]]


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    for out in (dedup_lines(empty), jaccard_join(empty), remove_repeats(empty), find_personal_data(empty), judge_quality(empty), leaks(empty, benchmark), leaks(empty, benchmark.limit(0)), pack(empty, WORDS), token_files.token_table(empty, BYTES)):
        assert out.select(F.col(out.columns[0])).count() == 0

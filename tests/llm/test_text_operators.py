"""Tokenizer operators, packing, secrets: against the libraries and brute force."""

import base64
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tardy.llm import packing, queries, secrets, sentencepiece_codec, token_counts
from tardy.llm.common import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)

EDGE = [None, "", " ", "a", "   two  spaces ", "\n\n \n", "x" * 5000, "a  b c", "执 é ſ ▁ <s>",
        "<|endoftext|> a<|endoftext|>", "tab\t\x0b\x1c end ", "İΣΣ Σ", "a" * 40 + " " * 40 + "b"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    signs = "  aehtinrsAé\n\t ▁　\x1c\x85執\U0001f600é0129'’.,!<|endoftext|><s><0x0A>ſİ"
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(n)]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, f"z{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    return df if extra else df.drop("ids")


def test_token_counts_equal_the_library(spark):
    texts = EDGE + random_texts(300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.count_tokens(docs_of(spark, texts, True), path, public_tokenizers.PATTERN).collect()
    tool = Tokenizer.from_file(path)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(tool.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 512), repr(text)


def test_token_counts_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = dict(zip(docs.doc_id, (len(e.ids) for e in tool.encode_batch(
        docs.text.tolist(), add_special_tokens=False))))
    got = queries.op7_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == expected and len(got) == len(docs)


def test_sentencepiece_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    texts = EDGE + random_texts(300) + docs.text.tolist()
    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encode_texts(docs_of(spark, texts, True), path, with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tool.encode(texts[r.doc_id] or "")
        back = tool.decode(ids)
        assert r.ids == ids and r.decoded == back and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_pair_test_agrees_with_replayed_merges():
    table, _ = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    for _ in range(3000):
        a, b = r.randrange(len(table.piece)), r.randrange(len(table.piece))
        if table.piece[b].startswith("▁"):
            continue
        merged = table._replay(table.piece[a] + table.piece[b], len(table.piece))
        assert table.compatible(a, b) == (merged == (a, b))


def check_packing(spark, texts, **options):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs_of(spark, texts, True), path, **options).toPandas()
    tool = Tokenizer.from_file(path)
    for i, own in got.groupby("doc_id"):
        ids = tool.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        own = own.sort_values("start")
        assert own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist()
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        assert b"".join(own.ids) == np.array(ids, dtype="<u4").tobytes()
    assert got.doc_id.nunique() == len(texts)
    short = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == np.r_[0, seq.length.cumsum()[:-1]].tolist()
        total, tier = seq.length.sum(), seq.tier.iloc[0]
        assert seq.tier.nunique() == seq.step_group.nunique() == 1 and total <= tier <= 4096
        short += total < tier
    return got, short


def test_packing_covers_every_id_once(spark):
    texts = EDGE + random_texts(60) + ["word " * n for n in (5000, 9000, 3000, 1500, 700, 511, 4095, 4096)]
    got, short = check_packing(spark, texts)
    assert short <= spark.sparkContext.defaultParallelism
    check_packing(spark, texts, pool_tokens=3000, tiers=(64, 16))


def test_packing_of_the_table_pads_little(spark):
    got = queries.op3_packing(spark, SF).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padded <= 4096
    assert set(got.tier) <= set(packing.TIERS)


def test_step_groups_are_balanced():
    sizes = [4096] * 10 + [1024] * 30 + [512] * 9
    groups = packing.deal_steps(sizes, 16384)
    loads = np.bincount(groups, weights=sizes)
    assert loads.max() - loads.min() <= 4096


def base_spans(text):
    """Brute force of the three base patterns, as the contract words them."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_secrets_base_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    texts = EDGE + docs.text.tolist() + [
        "password=token: abcdefg", "API_KEY = 'abc' secret:\"abcdef\"", "éé AKIA" + "A" * 16 + "B",
        "token=" + "a1" * 20, "AKIAAAAA" + "f" * 24, "tokens = x; passwd:  'longenough'"]
    got = secrets.scan(docs_of(spark, texts, True)).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(text.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 5


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def test_structures_are_confirmed_by_decoding():
    key = der(0x30, der(2, b"\0") + der(2, bytes(range(1, 200))) + der(0x30, der(2, b"\5") + der(4, b"abc" * 20)))
    text64 = base64.b64encode(key).decode()
    wrong64 = base64.b64encode(key[:-3]).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + text64 + "\n-----END RSA PRIVATE KEY-----"
    url = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}.c2ln"
    no_jwt = f"{url({'typ': 'x'})}.{url({'sub': 1})}.c2ln"
    kinds = lambda t: {k for k, _, _ in secrets.find_secrets(t)}
    assert kinds(pem) == {"pem", "der"} and kinds(pem.replace(text64, wrong64)) == set()
    assert kinds(f"a {text64} b") == {"der"} and kinds(key.hex()) == {"hex", "der"}
    assert kinds(jwt) == {"jwt"} and kinds(no_jwt) == set() and kinds("eyJhbGciOi.x.y") == set()
    ssh = b"openssh-key-v1\0" + b"".join(len(f).to_bytes(4) + f for f in (b"none", b"none", b"")) + (1).to_bytes(4)
    assert secrets.is_key(ssh) and not secrets.is_key(ssh[:20])


def test_key_runs_of_every_form():
    r = random.Random(8)
    key = der(0x30, der(2, b"\0") + der(2, r.randbytes(200)) + der(0x30, der(2, b"\5") + der(4, r.randbytes(70))))
    text64 = base64.b64encode(key).decode()
    bare = text64.rstrip("=")
    wrapped = lambda t, eol="\n": eol.join(t[i:i + 64] for i in range(0, len(t), 64))
    ders = lambda t: [(a, b) for k, a, b in secrets.find_secrets(t) if k == "der"]
    ssh = b"openssh-key-v1\0" + b"".join(len(f).to_bytes(4) + f for f in (b"none", b"none", b"")) + (1).to_bytes(4) \
        + b"".join(len(f).to_bytes(4) + f for f in (r.randbytes(51), r.randbytes(140)))
    ssh64 = base64.b64encode(ssh).decode()
    for body in (text64, wrapped(text64), wrapped(text64, "\r\n"), base64.urlsafe_b64encode(key).decode(), key.hex(),
                 key.hex().upper(), wrapped(key.hex().upper()), ssh64, wrapped(ssh64), ssh.hex()):
        assert ders(body) == [(0, len(body))]
        assert ders(f"see /{body}\nthe end") == [(5, 5 + len(body))]
    assert ders(f"x+{text64} y") == [(2, 2 + len(text64))]
    for cut in (bare[:-6], wrapped(bare[:-6]), key.hex()[:-6], wrapped(bare[:-6]) + "\n-----END KEY-----"):
        assert ders(cut) == []
    url = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    for head in ('{ "alg": "HS256"}', '{\n "alg": "HS256"}', ' {"alg":"HS256"}', '{"alg":"HS256"}'):
        token = f'{url(head)}.{url(chr(123) + " }")}.c2ln'
        for before in ("", "see ", "longer-prefix."):
            assert ("jwt", len(before), len(before + token)) in secrets.find_secrets(before + token)
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,CLEAR\nComment: a key\n\n{wrapped(text64)}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", 0, len(pem)) in secrets.find_secrets(pem)


def test_redaction_removes_every_secret(spark):
    texts = ["token = abcdefgh and AKIA" + "B" * 16 + " end", None, "", "clean text", "x " + "0f" * 20]
    df = docs_of(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in secrets.redact_secrets(df).collect()}
    assert got[0].text == "[assign] and [access] end" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "" and got[3].text == "clean text" and got[4].text == "x [hex]"


@pytest.mark.parametrize("name", ["op3_packing", "op6_sentencepiece", "op7_token_counts", "op10_secrets"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_crc_of_pieces(spark):
    packed = packing.pack(docs_of(spark, ["some words here"]), public_tokenizers.path("word_bpe_49k.json"))
    r = packed.select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(r.ids)


def _ssh_key():
    def part(b):
        return len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4, "big") + part(b"k" * 51) + part(b"p" * 100)


@pytest.mark.parametrize("text", [
    "-----BEGIN A-----\nKey: v\n" + (" " + "x" * 31 + "\n") * 20000,
    "-----BEGIN A-----\n" * 50000, "-----BEGIN A-----" + "\nKey: v" * 50000 + "-----END A-----",
    base64.b64encode(random.Random(1).randbytes(750_000)).decode(),
    ("MII" + "A" * 61 + "\n") * 15000, ("MIIKAAIB" + "A" * 56 + "\n") * 15000, ("3082" + "0" * 60 + "\n") * 15000,
    "b3BlbnNzaC1rZXktdjEA\n" * 40000, "/MIIB" * 100000, "MIAwgDCA" * 100000])
def test_secret_scan_of_hostile_texts_is_linear(text):
    import time

    t = time.perf_counter()
    secrets.find_secrets(text)
    assert time.perf_counter() - t < 5


def test_armour_and_wrapped_keys():
    der = bytes.fromhex("3082010a02030102030201050482" + "00fc") + b"z" * 252
    der = b"\x30\x82" + (len(der) - 4).to_bytes(2, "big") + der[4:]
    for raw in (der, _ssh_key()):
        assert secrets.is_key(raw)
        for width in (24, 64, 10_000):
            for indent in ("", "  "):
                flat = base64.b64encode(raw).decode()
                body = "\n".join(indent + flat[i:i + width] for i in range(0, len(flat), width))
                for head in ("", "\n", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES,\n 0123\n\n", "Key: v\n"):
                    block = f"-----BEGIN KEY-----\n{head}{body}\n-----END KEY-----"
                    assert secrets.armoured_keys("x " + block + " y") == [(2, 2 + len(block))], (width, indent, head)
                (a, b), = secrets.key_runs("= " + body + " .")
                assert (a, b) == (2 + len(indent), 2 + len(body))
        assert secrets.armoured_keys(block.replace("END KEY", "END KEX")) == []


def test_long_runs_of_spaces_are_encoded_in_linear_time():
    import time

    path = public_tokenizers.path("piece_bpe_32k.model")
    table = sentencepiece_codec.PrefixTable(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for n in [*range(1, 70), 1000, 4097]:
        for text in (" " * n, "a" + " " * n + "b"):
            assert table.encode(text) == library.encode(text), n
    t = time.perf_counter()
    assert len(table.encode(" " * 1_000_000)) > 0
    assert time.perf_counter() - t < 5

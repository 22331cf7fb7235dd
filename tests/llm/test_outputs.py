"""Packing, token files, piece sampling, archives and fingerprints: exact round trips and brute force."""

import collections
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from voltlattice.llm import blocks, fingerprints, packing, piece_sampling, token_files, tokens, warc
from voltlattice.llm.catalog import QUERIES, SQL
from voltlattice.llm.common import read_table, shared_dir

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  a  b", "a\n b\n\n  c", "a \nb", "tab\tx\r\n y ", "it's  we'll 12 345", "<|endoftext|> x <|endoftext|>y", "é ß Ünï 漢字 🎉",
       "é Σας ΣΑΣ", " nbsp  em", "x" * 3000, "!!! ??? ...", "▁ literal ▁▁ x", "\x1c\x85 odd", "trailing ", " leading"]


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_encoder_equals_the_library(path, llm_spark, sf_dir):
    own, library = tokens.WordEncoder(path), Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in read_table(llm_spark, sf_dir, "documents").select("text").collect()]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_folded_texts_are_cut_as_a_whole():
    """Odd letters, digits and punctuations of usual texts give the library's ids; forms of one word share a part."""
    own, library = tokens.WordEncoder(WORD), Tokenizer.from_file(WORD)
    rng = np.random.default_rng(4)
    some = list("aZ'stredlvm .,_-9\u00b2\u00bd\u00aa\u00b5\u00df\u0130\u0181\u023a\n\t<|\u00ad")
    texts = ["".join(rng.choice(some, 12)) for _ in range(3000)] + [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}" for c in range(0x250)] + ["x <|endoftext|> Y"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    held = tokens.WordEncoder(WORD)
    held.encode("Haanth. haanth, HAANTH haanth! haanth")
    assert sum(map(len, (held.words, held.parts, held.folded))) == 4  # the word, a full stop, a comma, an exclamation mark


def test_encoders_of_the_files(llm_spark, sf_dir):
    """The faster way of byte-level vocabularies gives the library's ids; other vocabularies take the other one."""
    assert isinstance(tokens.encoder(BYTE), tokens.ByteEncoder) and isinstance(tokens.encoder(WORD), tokens.WordEncoder)
    own, library = tokens.encoder(BYTE), Tokenizer.from_file(BYTE)
    every = "".join(chr(c) for c in range(0x250))
    for t in ODD + [every, " ".join(every), "\n".join(every), "x\n\n\ny", "\n", "end\n", "don't we'll I'M 'sx ''s"] + [
            r["text"] for r in read_table(llm_spark, sf_dir, "documents").select("text").collect()]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, (t or "")[:80]


def test_word_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_HELD", 5)
    monkeypatch.setattr(tokens, "PARTS_HELD", 5)
    own, library = tokens.WordEncoder(BYTE), Tokenizer.from_file(BYTE)
    for k in range(30):
        text = f"word{k} more{k % 7} and{k}\nline{k % 3} x"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text).ids
    assert all(len(t) <= 5 and len(t.old) <= 5 for t in (own.words, own.firsts, own.parts))


def check_packing(rows, docs, end, size):
    """Every document's ids in pieces, every sequence gapless and within its size."""
    library = Tokenizer.from_file(BYTE)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert sum(r["piece"] == 0 for r in rows) == len(docs)
    for i, text in docs:
        ids = ids_of(library, text, end)
        lengths = packing.cut_lengths(len(ids), size)
        mine = {r["piece"]: r for r in by_doc[i]}
        if len(by_doc[i]) == len(lengths):
            start = 0
            for k, n in enumerate(lengths):
                assert (mine[k]["start"], mine[k]["length"], mine[k]["ids_crc32"]) == (start, n, zlib.crc32(ids[start:start + n].tobytes()))
                start += n
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end_at = 0
        for offset, length in sorted(parts):
            assert offset == end_at
            end_at += length
        assert end_at <= size
    return len(sequences)


def test_packing_query(llm_spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in read_table(llm_spark, sf_dir, "documents").collect()]
    rows = QUERIES["op1_best_fit_packing"](llm_spark, sf_dir).collect()
    used = check_packing(rows, docs, 0, 2048)
    assert used <= np.ceil(sum(r["length"] for r in rows) / 2048) * 1.02 + 1


def test_packing_of_odd_rows(llm_spark, odd, nothing):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows = packing.pack_documents(odd, BYTE, size=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, docs, 0, 64)
    assert packing.pack_documents(nothing, BYTE).count() == 0


def test_rounds_merge_what_partitions_leave(llm_spark, monkeypatch):
    """Bins of many partitions are merged by the tree; offsets follow the merges."""
    monkeypatch.setattr(packing, "FAN_IN", 4)
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 101, 6000)
    items = llm_spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "piece_key long, length long").repartition(20)
    rows = packing.pack(items, capacity=100, slack=0).collect()
    assert sorted(r["piece_key"] for r in rows) == list(range(6000))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], int(sizes[r["piece_key"]])))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= 1.05 * np.ceil(sizes.sum() / 100)


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 51, 300)
    bins, offsets, filled = packing.best_fit(sizes, 50)
    plain = []
    for k in np.argsort(-sizes, kind="stable"):
        fitting = [b for b in range(len(plain)) if plain[b] + sizes[k] <= 50]
        if fitting:
            most = max(plain[b] for b in fitting)
            assert filled[bins[k]] >= most and offsets[k] == most
            plain[next(b for b in fitting if plain[b] == most)] += sizes[k]
        else:
            assert offsets[k] == 0
            plain.append(sizes[k])
    assert sorted(plain) == sorted(filled)


def plain_token_rows(docs, path, end):
    library, at, out = Tokenizer.from_file(path), 0, []
    for i, text in docs:
        ids = ids_of(library, text, end)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query(llm_spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in read_table(llm_spark, sf_dir, "documents").collect())
    assert sorted(tuple(r) for r in QUERIES["op3_token_files"](llm_spark, sf_dir).collect()) == plain_token_rows(docs, WORD, 1)


def test_token_files_of_odd_rows(llm_spark, odd, nothing):
    folder = shared_dir(llm_spark, "test-tokens")
    kind = token_files.id_kind(50257)
    token_files.write(odd, folder, BYTE, 0, kind)
    rows = token_files.read(llm_spark, folder, kind).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows]
    assert got == plain_token_rows(docs, BYTE, 0)
    starts = np.concatenate([token_files.read_array(folder, f"offsets-{b:06d}.bin", np.dtype("<i8"))[:-1]
                             for b in sorted(r["block"] for r in llm_spark.read.parquet(f"{folder}/bases").collect())])
    assert starts.tolist() == [g[1] for g in got]
    empty = shared_dir(llm_spark, "test-tokens")
    token_files.write(nothing, empty, BYTE, 0, kind)
    assert token_files.read(llm_spark, empty, kind).count() == 0
    assert token_files.id_kind(65536).itemsize == 2 and token_files.id_kind(65537).itemsize == 4


def test_pieces_query_is_lossless(llm_spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op9_piece_sampling"](llm_spark, sf_dir).collect()}
    for r in read_table(llm_spark, sf_dir, "documents").collect():
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_pieces_of_odd_rows(llm_spark, odd, nothing):
    def coded(df, seed=0):
        return {(r["doc_id"], r["text"]): (bytes(r["ids"]), r["back"]) for r in df.select(
            "doc_id", "text", piece_sampling.encode_column(PIECE, "doc_id", F.col("text"), seed).alias("ids")).withColumn(
            "back", piece_sampling.decode_column(PIECE, "ids")).collect()}

    once = coded(odd)
    assert all(back == (text or "") for (_, text), (_, back) in once.items())
    assert coded(odd.repartition(7)) == once and coded(odd, seed=1) != once
    assert coded(nothing) == {}
    model = piece_sampling.pieces(PIECE, 1.0)
    for text, ids in zip(ODD, piece_sampling.encode_batch(model, list(range(len(ODD))), ODD)):
        assert piece_sampling.decode(model, ids) == text


def test_samples_follow_the_path_weights():
    """Frequencies of segmentations against all paths of a small lattice."""
    model = piece_sampling.pieces(PIECE, 1.0)
    word = piece_sampling.META + "then"

    def paths(at):
        if at == len(word):
            yield (), 0.0
        state = 0
        for j in range(at, len(word)):
            state = int(model._step(np.array([state]), np.array([ord(word[j])]))[0])
            if state < 0:
                return
            piece = int(model.piece_at[state])
            if piece >= 0:
                for rest, weight in paths(j + 1):
                    yield (piece, *rest), weight + model.weights[piece]

    every = {p: np.exp(w) for p, w in paths(0)}
    total, n = sum(every.values()), 20000
    seen = collections.Counter(tuple(np.frombuffer(b, "<u4").tolist()) for b in piece_sampling.encode_batch(model, list(range(n)), ["then"] * n))
    assert set(seen) <= set(every)
    for path, weight in every.items():
        p = weight / total
        assert abs(seen[path] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_archives_query(llm_spark, sf_dir):
    con = oracle.connection(sf_dir)
    assert oracle.compare(llm_spark, con, QUERIES["op5_warc"], SQL["op5_warc"], sf_dir)[0] == "ok"


def test_archives_of_odd_pages(llm_spark):
    big, edge = "b" * 1000, "e" * 999
    pages = [(1, "http://a/ x\ny", big), (2, None, big), (3, "http://ü/", edge), (4, "", edge), (5, "u", None), (6, "u", ""), (7, "u", "é" * 500),
             (9, "u", "é" * 500), (8, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", big), (10, "u", big), (None, "u", "n" * 1500), (11, "u", "n" * 1500)]
    df = llm_spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, key string, name string").repartition(3)
    arc, out = shared_dir(llm_spark, "test-arc"), shared_dir(llm_spark, "test-warc")
    names = warc.write_arc(df, arc)
    rows = warc.read_archives(warc.convert(names, arc, out), out).collect()
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    told = collections.Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    expected = collections.Counter()
    responded = set()
    for i, _, html in pages:
        data = (html or "").encode()
        copies = sum((h or "").encode() == data for _, _, h in pages)
        revisit = len(data) >= 1000 and copies > 1 and (i != last[html] or html in responded)
        if i == last[html or ""]:
            responded.add(html)
        expected[("" if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(last[html]) if revisit else None)] += 1
    assert told == expected
    assert all(r["payload"] is None or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in rows)
    # A revisit names the record, address and date of a response that is there; each archive begins with its description.
    target = warc.convert(names, arc, out)
    archives = [list(warc._records(out, r["name"], warc.read_warc)) for r in target.collect()]
    assert all(a[0][0]["WARC-Type"] == "warcinfo" and all(h["WARC-Type"] != "warcinfo" for h, _ in a[1:]) for a in archives)
    headers = [h for a in archives for h, _ in a[1:]]
    there = {h["WARC-Record-ID"]: h for h in headers if h["WARC-Type"] == "response"}
    revisits = [h for h in headers if h["WARC-Type"] == "revisit"]
    assert len(revisits) == sum(n for r, n in told.items() if r[3] == "revisit")
    for h in revisits:
        named = there[h["WARC-Refers-To"]]
        assert (named["WARC-Target-URI"], named["WARC-Date"], named["WARC-Payload-Digest"]) == (
            h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"])
    plain = warc.read_archives(target, out, payloads=False)
    assert plain.columns == ["key", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] and plain.count() == len(rows)
    none = warc.write_arc(df.limit(0), shared_dir(llm_spark, "test-arc"))
    assert warc.read_archives(warc.convert(none, arc, out), out).count() == 0


def test_archives_are_dealt_to_several_tasks(llm_spark):
    names = llm_spark.createDataFrame([(f"part-{k:06d}-00000.arc.gz",) for k in range(200)], "name string").coalesce(1)
    used = warc._spread(names).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(used) == int(llm_spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in used) < 100
    joined = names.join(names.withColumn("more", F.lit(1)).repartition("name"), "name", "left")
    assert len(warc._spread(joined).groupBy(F.spark_partition_id().alias("task")).count().collect()) == len(used)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_of_both_versions(version):
    blocks_ = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nwith http://lines 0.0.0.0", b"", b"\n\n", b"no http"]
    raw = warc.arc_header(version, "name", "20240101000000") + b"".join(
        warc.arc_record(version, f"http://x/{k}", "20240102030405", "text/html", b, "name", k) for k, b in enumerate(blocks_))
    records = list(warc.read_arc(io.BytesIO(raw)))
    assert [r.block for r in records] == blocks_ and [r.fields["URL"] for r in records] == [f"http://x/{k}" for k in range(4)]
    assert records[0].payload == b"body\nwith http://lines 0.0.0.0" and records[3].payload == b"no http"
    written = b"".join(warc.warc_record(r, warc.Response("7", "http://y/", "20230101") if k == 0 else None) for k, r in enumerate(records))
    back = list(warc.read_warc(io.BytesIO(written)))
    assert [h["WARC-Type"] for h, _ in back] == ["revisit", "resource", "resource", "resource"]
    assert back[0][0]["WARC-Date"] == "2024-01-02T03:04:05Z" and back[0][1] == b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"[:-0 or None]
    assert len({h["WARC-Record-ID"] for h, _ in back}) == 4
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(raw[:-12])))


def plain_vector(text):
    """The counts of units of a text, by unit."""
    units = collections.Counter()
    for paragraph in text.split("\n"):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", paragraph) if w]
        units.update(zip(words, [*words[1:], None]))
    return units


def test_fingerprint_query(llm_spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in read_table(llm_spark, sf_dir, "documents").collect())
    got = {r["doc_id"]: r for r in QUERIES["op4_fingerprints"](llm_spark, sf_dir).collect()}
    prints, errors = collections.defaultdict(set), []
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[:len(text) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[tuple(sorted(text.split("\n")))].add(r["fingerprint"])
        prints[tuple(sorted(edited.split("\n")))].add(r["edited_fingerprint"])
        for told, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = plain_vector(text), plain_vector(other)
            norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            errors.append(told - (sum(a[u] * b[u] for u in a) / norm if norm else 0))
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert np.sqrt(np.mean(np.square(errors))) < 0.13


def test_fingerprints_add_and_remove_paragraphs(llm_spark):
    rows = [("ab", "a b c\nd e"), ("ba", "d e\na b c"), ("a", "a b c"), ("b", "d e"), ("aa", "a b c\na b c")]
    df = fingerprints.vectors(llm_spark.createDataFrame(rows, "k string, text string"), ["k"])
    v = {r["k"]: r["vector"] for r in df.collect()}
    assert v["ab"] == v["ba"] and v["a"] != v["aa"] and v["a"] != v["b"]
    lit = lambda x: F.array(*(F.lit(y) for y in x)).cast("array<long>")
    one = llm_spark.range(1)
    assert one.select(fingerprints.add(lit(v["a"]), lit(v["b"]))).first()[0] == v["ab"]
    assert one.select(fingerprints.remove(lit(v["aa"]), lit(v["a"]))).first()[0] == v["a"]


def test_fingerprints_of_odd_rows(llm_spark, odd, nothing):
    rows = fingerprints.compare_edits(odd).collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    expected = collections.Counter()
    for k, (i, text) in enumerate(docs):
        n = len(text) // 4
        expected[(i, len(text), hashlib.sha256((text[:len(text) - n] + docs[(k + 1) % len(docs)][1][:n]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert all(r["near_edited"] == 1 for r in rows if r["n_chars"] == 0)
    assert fingerprints.compare_edits(nothing).count() == 0


def test_blocks_ascend_and_are_balanced(llm_spark):
    df = llm_spark.range(5000).select(F.col("id") * F.col("id")).toDF("k").union(llm_spark.sql("SELECT CAST(NULL AS LONG) AS k"))
    cut = blocks.Blocks(df, "k", 40)
    rows = df.select("k", cut.column().alias("b")).collect()
    known = sorted((r["k"], r["b"]) for r in rows if r["k"] is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and cut.count > 30
    assert max(collections.Counter(b for _, b in known).values()) < 300
    assert [r["b"] for r in rows if r["k"] is None] == [0]


def test_joined_lattices_are_one_copy(llm_spark):
    """Lattices of later words are added to those held, and draws are those of lattices that are built at once."""
    from voltlattice.llm import piece_sampling

    texts, keys = ["one two three", "two, four", "five one  ", None, "", "Straße ▁ x"], list("abcdef")
    at_once, by_one = piece_sampling.Pieces(PIECE), piece_sampling.Pieces(PIECE)
    want = piece_sampling.encode_batch(at_once, keys, texts)
    got, held = [], None
    for key, text in zip(keys, texts):
        got += piece_sampling.encode_batch(by_one, [key], [text])
        assert held is None or by_one.held is held
        held = by_one.held
    assert got == want

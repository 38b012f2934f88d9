"""Each operator on nulls, empty and repeated rows, clashing names and empty tables, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from issuelens.llm import chat, imatch, mixing, packing, pii, quality, separators, sharding, tokens

VOCABULARY, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
SCHEMA = "doc_id long, text string, source string, words string, base string, id int, row string"


def rows():
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "Kö", "x", "Of"]) + str(rng.randrange(9)) * rng.randrange(2)
    out = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (None, "one two", "b"), (5, "the of " * 3000, "a"),
           (6, "a b c d e f g h\nmail x.y@z.org now\na b c d e f g h", "c")]
    out += [(10 + k, " ".join(word() for _ in range(rng.randrange(1, 200))), rng.choice("aab")) for k in range(40)]
    return [(*r, "w", "b", 7, "r") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    for r in quality.quality(docs).select("row.text", "m.*", "base_failed").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i:i + 8])].append(i)
        covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(none).count() == 0


def test_private_data(spark, docs, none):
    filler = lambda k: " ".join(f"{'abcdefghij'[k % 10] * 3}{c * 4}" for c in "qrstuvw")
    texts = [f"{filler(k)} secretname wrote from jo@site.org about {filler(k + 3)}" for k in range(5)] + [filler(k) for k in range(40)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
             .select("row.doc_id", "t", pii.listed(pii.F.col("spans")).alias("s")).collect()}
    for k, text in enumerate(texts):
        spans = [x.split(":") for x in found[k].s.split(",") if x]
        said = {(kind, text[int(a):int(b)]) for kind, a, b in spans}
        assert (("email", "jo@site.org") in said) == (k < 5) and (("term", "secretname") in said) == (k < 5)
    assert all("jo@site" not in (r.text or "") for r in pii.sanitise(docs.limit(1)).collect())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[6] == "a b c d e f g h\nmail [EMAIL] now\na b c d e f g h" and clean[1] is None and clean[2] == ""
    assert pii.sanitise(docs).columns == docs.columns and pii.find(none).count() == 0


def private(spark, texts):
    """(kind, text) of the spans of each text."""
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", pii.listed(pii.F.col("spans")).alias("s"))
    return {r.doc_id: {(kind, texts[r.doc_id][int(a):int(b)]) for kind, a, b in (x.split(":") for x in r.s.split(",") if x)} for r in found.collect()}


def test_terms_far_from_a_mention_disclose_it(spark):
    common = "some common words that every text of this table has in it again and again " * 8
    far = [f"Farname {common} mail far@site.org" for _ in range(5)]
    half = [f"Halfname {common if k % 2 else ''} mail half@site.org {k}" for k in range(6)]
    said = private(spark, [f"{k} {t}" for k, t in enumerate(far)] + half + [f"{common} {k}" for k in range(60)])
    for k, terms in said.items():
        assert (("term", "Farname") in terms) == (k < 5) and (("term", "Halfname") in terms) == (5 <= k < 11)
        assert not {v for kind, v in terms if kind == "term"} - {"Farname", "Halfname"}


def test_rare_entities_are_decided_by_chance(spark):
    copy = "Copyname of twelve@site.org wrote this"
    two = [f"Bo wrote to bo@x.org {k} this" for k in range(2)]
    one = ["Single wrote to single@y.org this"]
    said = private(spark, [copy] * 9 + two + one + [f"this wrote to of {k}" for k in range(300)])
    assert all(("term", "Copyname") in said[k] for k in range(9))
    assert all(("term", "Bo") in said[k] for k in (9, 10))  # two letters, two documents
    assert {v for kind, v in said[11] if kind == "term"} == set()  # one document shows nothing
    assert not any(said[k] for k in range(12, 312))


def test_a_text_of_many_addresses_is_not_paired_with_its_terms(spark):
    """1,000 addresses and 3,000 terms of one document: no pair can be decided, so none is made; a name of twelve documents is still found."""
    from pyspark.sql import functions as F

    crowd = " ".join(f"p{k}@x{k}.org " + " ".join("".join(random.Random(3 * k + j).choices("abcdefghij", k=9)) for j in range(3)) for k in range(1000))
    texts = [crowd] + [f"Findme wrote to one@site.org {k}" for k in range(12)] + [f"wrote to nothing {k}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mentions, terms = pii.disclosing_terms(docs)
    found = {(r.c, r.term) for r in terms.collect()}
    assert mentions.count() == 1000 + 12 and {c for c, _ in found} == {"email:one@site.org"} and ("email:one@site.org", "findme") in found
    # against all pairs, by counting
    words = [set(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    total, distinct = len(texts), len(set().union(*words))
    best = 1 * math.log(total / 1)
    assert best < math.log(distinct / 0.01)   # what one document can show at most
    assert pii.find(docs).select(F.size("base")).orderBy(F.desc(F.size("base"))).first()[0] == 1000


def test_mixing(docs, none):
    one, two = (Counter(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert one == two and mixing.mix(none).count() == 0
    many = mixing.replicate(docs, weights={"a": 1000.0, None: 0.5, "b": 0.0}, epochs=20.0).select("row.source", "copy", "row.doc_id").collect()
    assert {r.source for r in many} == {"a", None}
    assert len({(r.doc_id, r.copy) for r in many}) == len(many)
    rate = mixing.rates(docs, weights={None: 0.5, "a": 1000.0}, epochs=20.0).filter("source is null").first().rate
    assert abs(sum(r.source is None for r in many) - rate) < 8 * rate ** 0.5


def test_sharding(docs, none):
    got = sharding.interleave(docs, shards=5).collect()
    assert len(got) == docs.count() and sharding.interleave(none).count() == 0
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for source in "ab":
        per = Counter(r.shard for r in got if r.source == source)
        n = sum(per.values())
        assert all(abs(per[s] - n / 5) <= 2 for s in range(5))
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == want


def test_tokens_packing_and_separators(docs, none, tmp_path):
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "b'll", "12", "é", "日本", "<|endoftext|>", "The"]) for _ in range(rng.randrange(60)))
        assert tokens.encoder(VOCABULARY, RANKS).encode(text) == tokens.array("I", ids(text)).tobytes()
    packed = packing.pack(docs, VOCABULARY, RANKS, with_ids=True)
    got = packed.collect()
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter(tokens.array("I", [*ids(r[1]), 0]).tobytes() for r in rows())
    texts = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
    singles = Counter(bytes(r.ids) for r in got if r.piece == 0)
    assert all(singles[x] >= n for x, n in want.items() if len(x) <= 4 * 2048)
    assert sum(r.length for r in got) == sum(len(x) // 4 * n for x, n in want.items()) and not texts
    assert packing.sequences(packed).count() == len(fill) and packing.pack(none, VOCABULARY, RANKS).count() == 0
    lengths = sorted((r[0] or -1, len(ids(r[1]))) for r in rows())
    for block in (16, 1 << 16):
        stream = separators.token_stream(docs, VOCABULARY, RANKS, block=block)
        assert sorted((r.label or -1, r.n_tokens) for r in separators.scan(stream, chunk=4).collect()) == lengths
    files = separators.write_token_files(separators.token_stream(docs, VOCABULARY, RANKS, block=64), f"file://{tmp_path}")
    assert files.count() == 3
    back = separators.scan(separators.read_token_files(docs.sparkSession, f"file://{tmp_path}", block=32), chunk=4)
    assert sorted(r.n_tokens for r in back.collect()) == sorted(n for _, n in lengths)
    assert separators.scan(separators.token_stream(none, VOCABULARY, RANKS)).count() == 0


def test_imatch(docs, none):
    got = imatch.edit_report(docs).collect()
    texts = defaultdict(set)
    for r in got:
        texts[r.id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(got) == docs.count() and len(texts[4]) == 1 and imatch.edit_report(none).count() == 0
    numbered = sorted((r for r in rows() if r[0] is not None and r[0] >= 10), key=lambda r: r[0])
    by_id = {r.id: r for r in got}
    for r, after in zip(numbered, numbered[1:]):
        n = len(r[1]) // 4
        edited = r[1][:len(r[1]) - n] + after[1][:n]
        assert by_id[r[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_chat(spark):
    hard = ["\\", "###", "####", "</turn>\n", "\\h", "### user: </turn>", "a:b", "", "<</turn>", "\\b\\l"]
    turns = [(f"r{k}: \\", t) for k, t in enumerate(hard)] + [("assistant", t) for t in hard]
    text, mask = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == hard
    tree = [("t", 5, 1, None, "user", "q", None), ("t", 5, 2, 1, "assistant", "bad", 0.1), ("t", 5, 3, 1, "assistant", "good", 0.9),
            ("t", 5, 4, 3, "user", None, 0.0), ("u", None, 1, 99, None, "alone", None)]
    said = spark.createDataFrame(tree, "tree string, id long, node long, parent long, role string, text string, score double")
    best = {r.tree: chat.parse_turns(r.formatted) for r in chat.format_paths(said).collect()}
    assert best == {"t": [("user", "q"), ("assistant", "good"), ("user", "")], "u": [("", "alone")]}
    assert chat.format_paths(said, None).count() == 3 and chat.format_paths(said.limit(0)).count() == 0
    loop = spark.createDataFrame([("t", 1, 2), ("t", 2, 1)], "tree string, node long, parent long")
    with pytest.raises(ValueError):
        chat.format_paths(loop.selectExpr("*", "1L AS id", "'user' AS role", "'x' AS text", "0D AS score"))


def plain_paths(messages):
    """(tree, leaf) -> (score, nodes from the root), by walking up from every leaf."""
    parent = {(t, n): p for t, n, p, _ in messages}
    score = {(t, n): s or 0.0 for t, n, _, s in messages}
    above = {(t, p) for (t, n), p in parent.items()}
    out = {}
    for t, n in parent:
        if (t, n) not in above:
            path = [n]
            while (t, parent.get((t, path[-1]))) in parent:
                path.append(parent[t, path[-1]])
            out[t, n] = (sum(score[t, x] for x in path), path[::-1])
    return out


def test_paths_are_ranked_before_they_are_written(spark):
    rng = random.Random(4)
    tree = [("a", n, rng.randrange(n) if n else None, rng.choice([None, 0.5, 1.0, 0.25])) for n in range(60)]
    tree += [("b", n, n - 1 if n else 99, 0.5) for n in range(40)]   # a chain whose root's parent is not there
    chain = [("c", n, n - 1 if n else None, 0.0) for n in range(1000)] + [("c", 1000 + n, n, n % 7 / 4) for n in range(1000)]
    frame = spark.createDataFrame(tree + chain, "tree string, node long, parent long, score double").repartition(4)
    levels = chat.ancestors(frame)
    assert all(level.count() <= 2100 for level in levels)
    want = plain_paths(tree + chain)
    ranked = chat.best_paths(frame, levels, None).collect()
    assert {(r.tree, r.leaf): r.score for r in ranked} == {k: s for k, (s, _) in want.items()}
    best = chat.best_paths(frame, levels, 2)
    paths = chat.reply_paths(best, levels)
    got = defaultdict(list)
    for r in paths.orderBy(paths.up.desc()).collect():
        got[r.tree, r.leaf].append(r.node)
    assert set(got) == {(r.tree, r.leaf) for r in ranked if r.rank <= 2} and all(got[k] == want[k][1] for k in got)
    assert paths.count() <= 60 * 2 + 40 + 2 * 1001   # a path for each chosen leaf, not for all thousand

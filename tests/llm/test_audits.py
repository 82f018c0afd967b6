"""Source divergence, secret scan and prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardwatch.llm import divergence, queries, secrets, tries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least, top):
    rows = [(r.text or "", r.lang or "", r.source or "") for r in rows]
    docs, used, by_lang = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        used[lang, source].update(terms)
        docs.update((lang, term) for term in set(terms))
        by_lang[lang].add(source)
    out = []
    for lang, sources in by_lang.items():
        kept = [term for (of, term), n in docs.items() if of == lang and n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(used[lang, s]) for s in sources}
        q = shares(sum((used[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_with_odd_rows(spark, edge_docs, no_docs):
    columns = ("lang", "source", "part", "item", "value", "rank")
    random.seed(3)
    words = ["Alpha", "beta", "Gamma", "ünï", "日本", "delta", "eps", "zeta", "eta", "THETA"]
    rows = [(None if i % 17 == 0 else " ".join(random.choices(words[: 3 + i % 8], k=i % 40)), [None, "en", "en", "de"][i % 4], [None, "", "a", "b", "c"][i * i % 5], i) for i in range(400)]
    rows += [("lonely", "xx", "only", 1), (None, "yy", "k", 1), ("", "yy", "l", 2)] + [("tie tie2 tie3", "en", f"s{i % 2}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term int").repartition(7)
    for table, least, top in ((docs, 10, 3), (docs, 1, 100), (edge_docs, 2, 10)):
        found = divergence.source_divergence(table, least, top).select(*columns).collect()
        assert sorted(map(tuple, found)) == brute_divergence(table.collect(), least, top)
    assert divergence.source_divergence(no_docs).count() == 0


def test_divergence_counts_where_the_texts_lie(spark, monkeypatch):
    """A document's terms leave its task counted, not one row each; counts handed on early are added up."""
    text = "Ünï\x00İx \x85\u2028K Straße_日本--a1B\x1c𝒳z\x7f[q]" + " One two ONE" * 500
    wanted = Counter(re.findall(divergence.TERM, text.translate(LOWER)))
    assert Counter(t.decode() for t in divergence.terms_of(text.encode())) == wanted
    every = bytes(range(128)).decode() + "".join(map(chr, range(128, 0x600))) + "a"
    assert [t.decode() for t in divergence.terms_of(every.encode())] == re.findall(divergence.TERM, every.translate(LOWER))
    docs = spark.createDataFrame([(text, "en", s) for s in "ababa"], "text string, lang string, source string").coalesce(1)
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "source": s, "text": text.encode()} for s in "ababa"])
    assert sum(b.num_rows for b in divergence._count_terms([batch])) == 2 * len(wanted)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    assert sum(b.num_rows for b in divergence._count_terms([batch])) == 5 * len(wanted)
    found = divergence.source_divergence(docs, 2, 50).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == brute_divergence(docs.collect(), 2, 50)


def brute_base(text):
    text, out = text or "", []
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for rank, (kind, pattern, least) in enumerate((("assign", assign, 8), ("access", re.compile("(AKIA[A-Z0-9]+)"), 16), ("hex", re.compile("([0-9a-f]+)"), 32))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[m.lastindex]) >= least]
    return [span for _, _, span in sorted(out)]


def odd_secrets():
    key = "0123456789abcdef" * 2
    texts = [
        None, "", f"token={key} {key}z AKIA{'X' * 12} AKIAX", 'Password : "hunter22" passwd=short secret=token=abcdefgh12 API_KEY = \'A-b_c.d/e+f=\'',
        "token = secret=\"abcdefgh\"", "ſecret = abcdefghij toKen:abcdefgh", f"é日本 apikey={key}{key} 𝒳 {key}", "AKIAAKIAAKIAAKIA0 " + "a" * 31 + " " + "a" * 500,
        f"token = \"{key}\n", "x" * 40_000 + f" secret: {key}", "password==abcdefghi", "tokentoken = abcdefgh=",
    ]
    return [(i, t, "clash") for i, t in enumerate(texts)]


def test_base_spans(spark, sf_dir, edge_docs, no_docs):
    odd = spark.createDataFrame(odd_secrets(), "doc_id long, text string, spans string")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for docs in (odd, edge_docs, documents):
        found = secrets.with_secrets(docs, secrets.FormatModel({})).select("text", secrets.spans_text(F.col("spans"))).collect()
        assert len(found) == docs.count() and all(spans == ",".join(brute_base(text)) for text, spans in found)
    assert secrets.with_secrets(no_docs, secrets.fit_formats(no_docs)).count() == 0


def test_query_of_secrets(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, r.spans.split(",")))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(span.startswith(kind) for span in base) for kind in ("assign:", "access:", "hex:")]


def test_formats_are_inferred(spark):
    random.seed(5)

    def key():
        return "-".join("".join(random.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=5)) for _ in range(4))

    labelled = [(i, f"prose about things and a token = {key()} here {''.join(random.choices('0123456789', k=16))}") for i in range(60)]
    bare = [key() for _ in range(20)]
    words = ["internationalisation-of-everything", "https://example.com/a/long/path", "1234567890123456", "UPPERCASEWORDSALONE", "some.words_with+separators"]
    docs = spark.createDataFrame(labelled + [(100 + i, f"see {k} there") for i, k in enumerate(bare)] + [(200 + i, f"see {w} there") for i, w in enumerate(words)], "doc_id long, text string")
    model = secrets.fit_formats(docs)
    found = {r.doc_id: r.spans for r in secrets.with_secrets(docs, model).collect()}
    assert all(len(found[i]) == 1 and found[i][0].kind == "assign" and found[i][0].score > secrets.LEAST_SCORE for i in range(60))
    assert all([(s.kind, s.start, s.end) for s in found[100 + i]] == [("format", 4, 4 + len(k))] for i, k in enumerate(bare))
    assert all(found[200 + i] == [] for i in range(len(words)))
    # states are merged: the automaton is no larger than the form, however many values it is shown
    assert len(model.formats["assign"].seen) <= 60 and secrets.labelled_examples(docs.repartition(9)) == secrets.labelled_examples(docs)


def test_automaton_is_a_distribution():
    automaton = secrets.FormatAutomaton(["ab12", "cd34", "ef56xyz", "1-1", "2-3", "", "77"] * 30)
    for state, step in enumerate(automaton.taken):
        assert automaton.ends[state] + sum(step.values()) == automaton.seen[state]
    assert automaton.log_likelihood("ZZ") == -float("inf")


def brute_trie(rows):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            turns[r.conv_id].append(((r.turn is not None, r.turn or 0), (r.role or "", r.text or "")))
    turns = {c: [said for _, said in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt = turns.get(base, [])[:h] + own[h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append((c, len(rebuilt)))
    children, leaves, saved = Counter(), Counter(), Counter()
    children.update(node[:-1] for node in members if node)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c, n in sorted(of) if n == len(node))
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(of)[0], len(node), parent, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(spark):
    random.seed(11)
    said = ["hi", "", "no", None, "日本𝒳", "a longer thing to say"]
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(said[:3])) for c in [*range(95, 130), *range(-130, -90, 3), 200, 201] for t in range(c % 9)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(12)]  # copies
    rows += [(c, t, "user", f"chain {t}") for c in range(500, 530) for t in range(c - 495)]  # each a prefix of the next
    rows += [(100, None, "user", "null turn"), (100, 3, "user", "tie"), (100, 3, "user", "tie"), (101, None, None, None), (None, 1, "user", "nobody"), (2**40, 1, "user", "x")]
    rows += [(7, t // 3, "user", random.choice(said)) for t in range(400)]  # one conversation has a third of all rows
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(6)


@pytest.mark.parametrize("range_rows", [1_000_000, 50])
def test_trie(spark, range_rows):
    table = conversations(spark)
    nodes = tries.prefix_trie(table, range_rows)
    assert Counter(map(tuple, nodes.select(*NODE).collect())) == brute_trie(table.collect())


def test_trie_tells_colliding_prefixes_apart(spark, monkeypatch):
    table = conversations(spark).filter("conv_id BETWEEN 95 AND 130")
    want, asked = brute_trie(table.collect()), []
    whole = tries._fingerprinted

    def first_weak(turns, bases, primes):
        asked.append(bases)
        return whole(turns.withColumns({w: F.col(w) % 2 for w in tries._WORDS[:3]}) if len(asked) == 1 else turns, bases, primes)

    monkeypatch.setattr(tries, "_fingerprinted", first_weak)
    assert Counter(map(tuple, tries.prefix_trie(table).select(*NODE).collect())) == want
    assert len(asked) == 2


def test_trie_of_nothing(spark):
    assert tries.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_references_lead_to_the_last_turn(spark):
    table = conversations(spark).filter("conv_id >= 300")
    turns = tries.stored_turns(table)
    nodes = tries.prefix_trie(table)
    assert nodes.join(turns, (nodes.ref_conv == turns.conv_id) & (nodes.ref_pos == turns.pos)).count() == nodes.filter("depth > 0").count()

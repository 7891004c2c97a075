"""Line dedup, near duplicates, decontamination, secrets and toxicity on small fixtures."""

from __future__ import annotations

import base64
import json
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from payload_metrics.llm import decontaminate, secrets, simhash, site_lines, toxicity
from payload_metrics.llm.common import known_labels, labelled_sample
from payload_metrics.llm.components import connected_components

DOCS = "doc_id long, text string, source string, fp string, row string, _lines string, n_lines int"


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "a", "b", "c", 7) for i, t, s in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


# --- site-relative line dedup


def plain_lines(rows, ratio, least):
    pages = {}
    for _, text, host in rows:
        pages.setdefault(host, []).append(set() if text is None else set(text.split("\n")))
    cut = []
    for _, text, host in rows:
        if text is None:
            cut.append(None)
            continue
        mine = pages[host]
        keep = [
            line
            for line in text.split("\n")
            if (n := sum(line in page for page in mine)) < least or n <= ratio * len(mine)
        ]
        cut.append("\n".join(keep) if any(keep) else text)
    return cut


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    pool = [words(rng, 4) for _ in range(12)] + [""]
    rows = []
    for i in range(120):
        host = rng.choice(["big"] * 5 + ["small", None])
        text = "\n".join(rng.choices(pool, k=rng.randint(1, 3)) + [words(rng, 5)] * rng.randint(0, 2))
        rows.append((i, rng.choice([text, text, text, None, ""]), host))
    rows += rows[:5]
    found = site_lines.drop_boilerplate(documents(spark, rows), ratio=0.1, min_pages=3).collect()
    expected = sorted(zip([r[0] for r in rows], plain_lines(rows, 0.1, 3)), key=repr)
    assert sorted([(r.doc_id, r.text) for r in found], key=repr) == expected
    assert {r["fp"] for r in found} == {"a"} and {r["_lines"] for r in found} == {"c"}
    changed = {r.doc_id for r in found if r.n_dropped}
    assert changed and all(r.n_lines == len(r.text.split("\n")) + r.n_dropped for r in found if r.text is not None)


def test_page_of_boilerplate_only_stays(spark):
    rows = [(i, "menu\nhome", "h") for i in range(6)] + [(9, "menu\nnews", "h")]
    found = {r.doc_id: r.text for r in site_lines.drop_boilerplate(documents(spark, rows)).collect()}
    assert found == {**{i: "menu\nhome" for i in range(6)}, 9: "news"}


def test_lines_of_an_empty_table(spark):
    assert site_lines.drop_boilerplate(documents(spark, [])).count() == 0


# --- near duplicates


def plain_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(found[i : i + 4]) for i in range(max(len(found) - 3, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    names = {}
    for fp in fps:
        group, queue = {fp}, [fp]
        while queue:
            at = queue.pop()
            near = {x for x in fps if (x ^ at).bit_count() <= 4} - group
            group |= near
            queue += near
        names[fp] = min(i for x in group for i in fps[x])
    return names


def near_rows():
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = words(rng, rng.choice([0, 1, 3, 4, 40, 400]))
        rows.append((i, text, "s"))
        for k in range(rng.randint(0, 4)):
            edited = text.split(" ")
            edited[rng.randrange(len(edited))] = "edited"
            rows.append((1000 + 10 * i + k, rng.choice([text, text.upper(), " ".join(edited)]), "s"))
    return rows + [(2000, None, "s"), (2001, " \t\n", "s"), (2002, "Été   x", "s"), rows[3]]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    fps = {}
    for i, text, _ in rows:
        fps.setdefault(plain_fingerprint(text), []).append(i)
    names = plain_components(fps)
    found = simhash.near_duplicates(documents(spark, rows))
    found = found.withColumn("hex", simhash.as_hex(F.col("fp"))).collect()
    expected = sorted((i, format(fp := plain_fingerprint(t), "016x"), names[fp]) for i, t, _ in rows)
    assert sorted((r.doc_id, r.hex, r.component_id) for r in found) == expected
    kept = simhash.deduplicate(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(names.values()))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and {r.fp for r in kept.collect()} == {"a"}


def test_links_of_planted_distances(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        fps.add(fp)
        for distance in (1, 2, 3, 4, 5, 6):
            fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), distance)))
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, fp) for i, fp in enumerate(signed)], "doc_id long, fp long")
    names = plain_components({fp: [i] for i, fp in enumerate(sorted(fps))})
    found = {r.fp: r.component_id for r in simhash.components(rows).collect()}
    assert found == {s: names[u] for s, u in zip(signed, sorted(fps))}


def test_blocks_of_a_common_key_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rows = spark.createDataFrame([(i, 1 << i) for i in range(20)], "doc_id long, fp long")
    assert {r.component_id for r in simhash.components(rows).collect()} == {0}


def test_ids_that_are_null(spark):
    rows = [(None, "one two three four five", "s"), (None, "one two three four five", "s"), (4, "other words here", "s")]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (-1, -1), (4, 4)]
    assert simhash.deduplicate(documents(spark, rows)).count() == 2
    assert simhash.deduplicate(documents(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    order = rng.sample(range(300), 300)
    edges = list(zip(order[:100], order[1:101])) + [(order[150], x) for x in order[151:200]] + [(7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    chain, hub = order[:101], order[150:200]
    assert all(found[x] == min(chain) for x in chain) and all(found[x] == min(hub) for x in hub)


# --- decontamination


def edit_distance_within(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        before, row[0] = row[0], 0
        for i, own in enumerate(item, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (own != char))
        best = min(best, row[-1])
    return best


def test_myers_matches_the_plain_recurrence():
    rng = random.Random(5)
    for _ in range(60):
        item, text = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert min(min(decontaminate.distances(item, text)), len(item)) == edit_distance_within(item, text)
        column = list(range(len(item) + 1))
        for j, char in enumerate(text, 1):
            before, column[0] = column[0], j
            for i, own in enumerate(item, 1):
                before, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, before + (own != char))
        assert list(decontaminate.distances(item, text, anchored=True))[-1] == column[-1]


def test_edits_within_the_budget_are_found(spark):
    rng = random.Random(6)
    items = [(i, words(rng, 30)) for i in range(8)] + [(8, None), (9, "  "), (3, words(rng, 20))]
    rows, expected = [], set()
    for i in range(60):
        item_id, item = rng.choice([x for x in items if x[1] and x[1].strip()])
        edited, budget = list(item), int(len(item) * decontaminate.ERROR_SHARE)
        for at in rng.sample(range(len(edited)), rng.choice([0, 1, budget, 4 * budget])):
            edited[at] = rng.choice(["", "Z", edited[at] + "q"])
        rows.append((i, f"{words(rng, 20)}\n{''.join(edited).upper()}  {words(rng, 5)}", "s"))
    rows += [(100, None, "s"), (101, "", "s"), rows[0]]
    for i, text, _ in rows:
        for item_id, item in items:
            plain = decontaminate.normal(item or "")
            if plain and edit_distance_within(plain, decontaminate.normal(text or "")) <= int(len(plain) * decontaminate.ERROR_SHARE):
                expected.add((i, item_id))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and 20 < len(expected) < 60
    text = {i: t for i, t, _ in rows}
    for r in found:
        held = [decontaminate.normal(t) for i, t in items if i == r.item_id]
        spans = decontaminate.normal(text[r.doc_id][r.start : r.end])
        assert any(edit_distance_within(t, spans) <= r.distance + 1 for t in held)
    clean = decontaminate.decontaminate(documents(spark, rows), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _, _ in rows if i not in {d for d, _ in expected})
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, rows), nothing).count() == len(rows)


def test_items_pass_in_blocks(spark):
    benchmark = spark.createDataFrame([(i, "x" * 50) for i in range(7)] + [(9, None)], "item_id long, text string")
    assert [len(b) for b in decontaminate.blocks(benchmark, 100)] == [2, 2, 2, 1]


def test_items_without_an_id(spark):
    """They are found under a null id, beside others in one text; the query does not stumble."""
    rng = random.Random(16)
    items = [(None, words(rng, 30)), (1, words(rng, 30)), (None, words(rng, 30)), (2, None)]
    rows = [(0, f"{items[0][1]} {items[1][1]}", "s"), (1, items[2][1], "s"), (2, words(rng, 30), "s"), (None, items[1][1], "s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(documents(spark, rows), benchmark).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == [("0", "1"), ("0", "None"), ("1", "None"), ("None", "1")]


@pytest.mark.parametrize("block_chars", [1, 400, 10**6])
def test_blocks_find_what_one_block_finds(spark, block_chars):
    rng = random.Random(17)
    items = [(i, words(rng, 30)) for i in range(6)]
    rows = [(i, f"{words(rng, 9)} {items[i % 8][1] if i % 8 < 6 else ''} {words(rng, 9)}", "s") for i in range(24)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    found = decontaminate.contaminated(docs, benchmark, block_chars=block_chars).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted((i, i % 8) for i in range(24) if i % 8 < 6)
    clean = decontaminate.decontaminate(docs, benchmark, block_chars=block_chars)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(24) if i % 8 >= 6] and clean.columns == docs.columns
    none = benchmark.limit(0)
    assert decontaminate.contaminated(docs, none).columns == ["doc_id", "item_id", "start", "end", "distance"]
    assert decontaminate.contaminated(docs, none).count() == 0


# --- samples


def test_repeats_of_a_labelled_id_stay_within_the_bound(spark):
    rows = [(7, f"text {i}", "s") for i in range(5000)] + [(i, "other", "s") for i in range(100, 140)] + [(None, "x", "s")]
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, i % 2) for i in range(100, 140)], (None, 1)], "doc_id long, quality int")
    known = known_labels(labels, "quality")
    for per_class in (1, 10, 100):
        sample = labelled_sample(documents(spark, rows), known, per_class).collect()
        counts = {y: sum(r.y == y for r in sample) for y in (0, 1)}
        assert counts[0] == min(per_class, 20) and counts[1] == min(per_class, 21)
        assert all(r.text == "text 0" for r in sample if r.doc_id == 7)


# --- secrets


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


def pkcs8(rng):
    algorithm = der(0x30, der(0x06, bytes.fromhex("2a8648ce3d0201")) + der(0x05, b""))
    return der(0x30, der(0x02, b"\0") + algorithm + der(0x04, rng.randbytes(120)))


def token(header):
    parts = [json.dumps(x).encode() for x in (header, {"sub": "someone", "n": 1})] + [b"signature" * 3]
    return ".".join(base64.urlsafe_b64encode(p).decode().rstrip("=") for p in parts)


ENCRYPTED = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789abcdef0123456789ABCDEF"


def test_structures_are_confirmed():
    rng = random.Random(7)
    key = pkcs8(rng)
    coded = base64.b64encode(key).decode()
    lines = "\n".join(coded[i : i + 64] for i in range(0, len(coded), 64))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    openssh = secrets.OPENSSH + b"".join(
        len(p).to_bytes(4, "big") + p if p != b"one" else (1).to_bytes(4, "big")
        for p in (b"none", b"none", b"", b"one", rng.randbytes(51), rng.randbytes(136))
    )
    cipher = base64.b64encode(rng.randbytes(240)).decode()
    for text, kind in [
        (coded, "key"),
        (key.hex(), "key"),
        (base64.b64encode(openssh).decode(), "key"),
        (pem, "pem"),
        (pem.replace("\n", "\\n"), "pem"),
        (pem.replace("\n", "\\r\\n"), "pem"),
        (pem.replace("PRIVATE KEY-----\n", "PRIVATE KEY-----\nComment: a key\nNote: mine, since 2020\n\n", 1), "pem"),
        (f"-----BEGIN RSA PRIVATE KEY-----\n{ENCRYPTED}\n\n{cipher}\n-----END RSA PRIVATE KEY-----", "pem"),
        (f"-----BEGIN RSA PRIVATE KEY-----\n{ENCRYPTED}\n\n{cipher}\n-----END RSA PRIVATE KEY-----".replace("\n", "\\n"), "pem"),
        (token({"alg": "HS256", "typ": "JWT"}), "jwt"),
    ]:
        start = len("Été: ")
        assert (kind, start, start + len(text)) in secrets.spans_of(f"Été: {text} end")
    for text in [
        base64.b64encode(rng.randbytes(160)).decode(),
        base64.b64encode(key[:-3]).decode(),
        base64.b64encode(key + b"\0").decode(),
        token({"typ": "JWT"}),
        pem.replace(coded[:20], "A" * 20),
        pem.replace("\n", "\\t"),
        f"-----BEGIN RSA PRIVATE KEY-----\nNote: not encrypted\n\n{cipher}\n-----END RSA PRIVATE KEY-----",
        f"-----BEGIN RSA PRIVATE KEY-----\n{ENCRYPTED}\n\n{cipher[:-8]}\n-----END RSA PRIVATE KEY-----",
        f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{cipher}\n-----END RSA PRIVATE KEY-----",
    ]:
        assert {k for k, _, _ in secrets.spans_of(text)} <= set(secrets.BASE_KINDS)


BASE_PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(8)
    bits = ["token", "Secret", "api_key", "APIKEY", "toKen", "paſſwd", "=", ":", " ", "'", '"', "AKIA", "ABCD0123456789XY", "deadbeef01", "é", "abc", "\n", "_.-", "token: secret : "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)] + [None, "", "token=" + "x" * 5000]
    rows = list(enumerate(texts))
    found = documents(spark, [(i, t, "s") for i, t in rows]).select("doc_id", secrets.spans(F.col("text")).alias("s"))
    found = found.select("doc_id", secrets.listed(F.col("s"), secrets.BASE_KINDS).alias("base"), secrets.count(F.col("s"), "hex").alias("n"))
    least = {"assign": 12, "access": 18, "hex": 16}
    for row in found.collect():
        expected = []
        for rank, (kind, pattern) in enumerate(BASE_PATTERNS.items()):
            for m in re.finditer(pattern, texts[row.doc_id] or ""):
                if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                    expected.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        assert row.base == ",".join(x[2] for x in sorted(expected))
        assert row.n == sum(x[1] == 2 for x in expected)


# --- toxicity


def test_toxic_documents_are_told_apart(spark):
    rng = random.Random(9)
    insults = ["blorgface", "znit", "quxhead"]
    rows, labels = [], []
    for i in range(240):
        text, toxic = words(rng, rng.randint(20, 60)).split(), i % 3 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "znit, ZNIT! " + words(rng, 20_000), "s"), rows[0]]
    train = [x for x in labels if x[0] % 4] + [(1, None), (None, 1), (3, 0)]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(train, "doc_id long, toxic int"))
    found = toxicity.classify(documents(spark, rows), model)
    scores = {r.doc_id: r.toxic_score for r in found.collect()}
    right = sum((scores[i] >= 0.7) == bool(y) for i, y in labels if i % 4 == 0)
    assert right >= 58 and found.count() == len(rows)
    assert scores[900] == scores[901] < 0.5 and all(0 <= s <= 1 for s in scores.values())


def test_window_lengths_are_those_of_single_compressions():
    """Windows compressed together and remembered save what each saves when compressed alone."""
    rng = random.Random(19)
    toxic, ordinary = [" ".join(words(rng, 40) for _ in range(20)).encode() for _ in range(2)]
    model = toxicity.ToxicityModel(toxic, ordinary, ())
    texts = [words(rng, 30).encode().split() + toxic.split()[i : i + 20] for i in range(0, 200, 20)]
    lead, tail = toxicity.LEAD, toxicity.TAIL
    alone = [toxicity._compressor(c + ordinary + lead + tail) for c in (b"", toxic)]

    def saved(word):
        one, two = [len(c.compress(lead + word + tail)) for c in alone]
        return one - two

    distance = toxicity.WindowDistance(model)
    for _ in range(2):
        got = distance.of(texts)
        assert got == [[n for w in ws if (n := saved(w))] for ws in texts] and any(got)
    assert distance.lengths([]) == {}


def test_dictionaries_part_in_rounds():
    """What both classes use ends up in the ordinary dictionary; the toxic one keeps its own words."""
    rng = random.Random(20)
    shared = {w.encode(): rng.randint(2, 60) for w in words(rng, 900).split()}
    own = {b"quxhead": 40, b"znitwort": 25, b"blorgface": 30}
    toxic, ordinary = toxicity._dictionaries({0: shared, 1: shared | own}, 65_536, 300_000, 3)
    saved = toxicity.WindowDistance(toxicity.ToxicityModel(toxic, ordinary, ())).lengths([*shared, *own])
    assert all(saved[w] > 0 for w in own) and sum(saved[w] > 0 for w in shared) < 0.02 * len(shared)


def test_many_rare_insults(spark):
    """150 insults, two in each toxic document, so each in about 1.3 % of them."""
    rng = random.Random(21)
    insults = ["".join(rng.choice("kvwxyz") + rng.choice("ou") for _ in range(rng.randint(3, 4))) for _ in range(150)]
    rows, labels = [], []
    for i in range(2400):
        text, toxic = words(rng, rng.randint(20, 60)).split(), i % 2
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, toxic))
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([x for x in labels if x[0] % 8 > 1], "doc_id long, toxic int"))
    found = {r.doc_id: r.toxic_predicted for r in toxicity.classify(docs, model).collect()}
    held = [x for x in labels if x[0] % 8 <= 1]
    caught = sum(found[i] for i, y in held if y) / sum(y for _, y in held)
    false = sum(found[i] for i, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.9 and false < 0.05, (caught, false)


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)])
def test_toxicity_without_both_classes(spark, labels, score):
    docs = documents(spark, [(1, "some words", "s"), (2, None, "s")])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.toxic_score for r in toxicity.classify(docs, model).collect()} == {score}

"""Secret scans: rules against plain loops, the network against a naive one, held-out secrets."""

import hashlib
import random

import numpy as np
import pytest

import edge
from tidewheel.llm import queries, secret_scan as ss

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def runs(text: str, allowed: str, at: int) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def naive_assign(text: str) -> list[tuple[int, int]]:
    """Reads the rule by hand, letter after letter."""
    out, at = [], 0
    while at < len(text):
        stop = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at : at + len(name)]) == name:
                i = at + len(name)
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                i = runs(text, " ", i)
                if text[i : i + 1] in ("=", ":") and text[i : i + 1]:
                    i = runs(text, " ", i + 1)
                    i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                    end = runs(text, ALNUM + "+/_.=-", i)
                    if end > i:
                        stop = end
                        if end - i >= 6:
                            out.append((at, end))
        at = stop or at + 1
    return out


def naive_runs(text: str, allowed: str, start: str, least: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        if text.startswith(start, at) and text[at] in allowed:
            end = runs(text, allowed, at)
            if end > at + len(start) or not start:
                if end - at >= least:
                    out.append((at, end))
                at = end
                continue
        at += 1
    return out


def naive_base(text: str) -> list[tuple[int, int, int]]:
    found = [(0, *s) for s in naive_assign(text)]
    found += [(1, *s) for s in naive_runs(text, ALNUM[:26] + ALNUM[52:], "AKIA", 20)]
    found += [(2, *s) for s in naive_runs(text, "0123456789abcdef", "", 24)]
    return sorted(found, key=lambda s: (s[1], s[0]))


AWKWARD = [
    "", "token", "token=", "token = 'abcdef'", 'Password":"a.b/c+d=', "PASSWD:12345", "api_key=Api_Key=apikey=xxxxxxxx",
    "password:token:abcdefgh", "secret :  \"0123456789abcdef0123456789abcdef\" tail", "ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "Z" * 15, "AKIA" + "Z" * 16, "xAKIAAKIA" + "0" * 16 + "z", "akia" + "0" * 23, "0" * 24, "g" + "a" * 23 + "G" + "f" * 24,
    "ümlaut 🙂 token=🙂abcdef token=abcdef🙂", "x" * 3000 + "1", "token=" + "x" * 300_000, "secretsecret=abcdef", "token==abcdef",
]


def test_rules_equal_a_plain_reading():
    rng = random.Random(1)
    bits = ["token", "Secret", "api_key", "API", "key", "=", ":", " ", "'", '"', "abc", "0f", "AKIA", "Z9", "é", "\n", "passwd", "password", "a" * 9, "0123456789abcdef"]
    texts = AWKWARD[:-3] + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(4000)]
    for text in texts:
        assert [s[:3] for s in ss.base_spans(text)] == naive_base(text), text


def test_candidates_touch_no_rule_and_hold_a_digit():
    for text in AWKWARD + ["id abcdefghijk1 token=abcdefghijk1 0123456789012 aaaaaaaaaaaaaaaaaaaaaaaa"]:
        found = ss.candidates(text)
        base = [s for s in found if s[0] < 3]
        for kind, start, stop, _, _ in found:
            if kind == 3:
                assert any(c.isdigit() for c in text[start:stop]) and all(stop <= b[1] or start >= b[2] for b in base)
    assert [s[0] for s in ss.candidates("id abcdefghijk1 token=abcdefghijk1 0123456789012")] == [3, 0, 3]


def some_net(seed: int = 0) -> ss.Net:
    return ss._fresh(0.3, np.random.default_rng(seed))


def naive_logit(net: ss.Net, row: tuple[str, str, str]) -> float:
    ids = [min(ord(c), 128) + 129 * part for part, text in enumerate(row) for c in text]
    hidden = []
    for width, bank, bias in zip(ss.WIDTHS, net.filters, net.biases):
        for f in range(ss.FILTERS):
            best = None
            for i in range(len(ids)):
                z = float(bias[f])
                for j in range(width):
                    if i + j < len(ids):
                        z += float(net.table[ids[i + j]] @ bank[j][:, f])
                best = z if best is None else max(best, z)
            hidden.append(max(bias[f] if best is None else best, 0))
    return float(np.array(hidden) @ net.out + net.offset)


@pytest.mark.parametrize("block", [ss.BLOCK_CHARS, 7])
def test_network_equals_naive_convolution(block, monkeypatch):
    """Also where a finding is longer than a block."""
    monkeypatch.setattr(ss, "BLOCK_CHARS", block)
    net = some_net()
    rows = [("let x ", "abc123", " é"), ("", "", ""), ("", "q", ""), ("z" * 24, "0f" * 40, "🙂 end"), ("", "ab", "")]
    assert np.allclose(net.logits(rows), [naive_logit(net, r) for r in rows], atol=1e-4)


def test_long_finding_scores_as_one(monkeypatch):
    net = some_net(3)
    row = ("k=", "".join(random.Random(2).choices(ALNUM, k=5_000)), " z")
    whole = net.logits([row])
    monkeypatch.setattr(ss, "BLOCK_CHARS", 100)
    assert np.allclose(net.logits([row]), whole, atol=1e-4)


def test_gradient_points_downhill():
    rng = np.random.default_rng(4)
    rows = [("", "".join(rng.choice(list("0123456789abcdef"), 30)), "") for _ in range(40)]
    rows += [("", "".join(rng.choice(list("0123456789"), 16)), "") for _ in range(40)]
    labels = np.array([1] * 40 + [0] * 40)
    scores = ss._sigmoid(ss.learned(rows, labels).logits(rows))
    assert scores[:40].min() > scores[40:].max()


def test_threshold_is_the_largest_of_enough_recall():
    rng = np.random.default_rng(5)
    for n in (1, 2, 10, 49, 50, 51, 200):
        scores = rng.random(n).round(2)
        t = ss.recall_threshold(scores, 0.98)
        assert (scores >= t).mean() >= 0.98
        larger = scores[scores > t]
        assert len(larger) == 0 or (scores >= larger.min()).mean() < 0.98
    assert ss.recall_threshold(np.zeros(0), 0.98) == np.inf


def labelled_docs(spark):
    """Keys in assignments and long hexadecimal runs for the rules; numbers, dates and serials
    beside them; and secrets no rule takes: shorter hexadecimal keys without a name."""
    rng = random.Random(7)
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k - 2)) + "a1"
    rows = []
    for i in range(600):
        kind = i % 4
        if kind == 0:
            text = f'some words {rng.choice(["token", "secret", "api_key"])} = "{hexa(40)}" more'
        elif kind == 1:
            text = f"see {hexa(rng.randint(24, 40))} here"
        elif kind == 2:
            text = f"call {rng.randint(10**15, 10**16 - 1)} or write"
        else:
            text = f"on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.randint(1000, 9999)} it was"
        rows.append((i, text, "en", "a"))
    hidden = [(1000 + i, f"use {hexa(22)} now", "en", "a") for i in range(30)]
    return edge.documents(spark, rows + hidden), {r[0] for r in hidden}


def test_added_spans_on_held_out_secrets(spark):
    docs, hidden = labelled_docs(spark)
    out = {r["doc_id"]: r["spans"] for r in ss.scan(docs).collect()}
    added = {d for d, spans in out.items() if any(s["kind"] == "other" and s["kept"] for s in spans)}
    assert len(added & hidden) >= 0.9 * len(hidden)
    plain = [d for d in out if d < 1000 and d % 4 > 1]
    assert len(added & set(plain)) <= 0.02 * len(plain)


def test_base_columns_on_awkward_rows(spark):
    rows = [(i, t, None, None) for i, t in enumerate(AWKWARD)] + [(None, "token=abcdef", None, None), (3, None, None, None)] + edge.ROWS
    docs = edge.clashing(edge.documents(spark, rows))
    got = sorted((repr(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in ss.report(docs).collect())
    want = []
    for doc, text, _, _ in rows:
        found = naive_base(text or "") if len(text or "") < 100_000 else [s[:3] for s in ss.base_spans(text)]
        said = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for k, a, b in found)
        want.append((repr(doc), *[sum(s[0] == k for s in found) for k in range(3)], hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)


def test_query_on_the_tables(spark, folder):
    out = queries.queries()["op12_secret_scan"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        said = [f"{ss.KINDS[k]}:{a}:{b}" for k, a, b in naive_base(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) | {""}
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)


def test_nothing_to_learn_from(spark):
    assert ss.report(edge.documents(spark, [])).count() == 0
    one = ss.report(edge.documents(spark, [(1, "token=abcdef and 1234567890123", None, None)])).collect()
    assert one[0]["spans"] == "assign:0:12"


def found_in(docs):
    """Findings stored once, as the query does."""
    return ss.stored(ss.findings(docs), "findings")


def test_shards_hold_every_distinct_finding(spark):
    """More findings than the former limit of 2000 a label, some longer than the former 512 characters."""
    rng = random.Random(11)
    value = lambda i: f"{i:06d}" + "".join(rng.choices(ALNUM, k=700 if i % 500 == 0 else 12))
    rows = [(i, f"token={value(i)} and {value(i)}" + ("" if i else f" {'q' * 70_000}7"), None, None) for i in range(2100)]
    rows += rows[:100]
    parts = ss.sharded(found_in(edge.documents(spark, rows).repartition(5)), 500).collect()
    plain = {(s[0], t[max(0, s[3] - 24) : s[3]], t[s[3] : s[4]], t[s[4] : s[4] + 24]) for _, t, _, _ in rows for s in ss.candidates(t)}
    assert len(parts) == len(plain) and {(r["kind"], r["before"], r["value"], r["behind"]) for r in parts} == plain
    assert sum(r["kind"] < 3 for r in parts) >= 2100
    sizes = {shard: sorted(r["position"] for r in parts if r["shard"] == shard) for shard in {r["shard"] for r in parts}}
    assert len(sizes) > 5 and all(p == list(range(len(p))) for p in sizes.values())


def test_long_findings_train(spark):
    """Values of which none is short enough for the former training sample."""
    rng = random.Random(12)
    some = lambda letters, k: "".join(rng.choices(letters, k=k - 1)) + "1"
    rows = [(i, f"token={some('0123456789abcdef', 600)}" if i % 2 else f"see {some('GHIJKLMNOP', 600)}", None, None) for i in range(80)]
    net = ss.fit(found_in(edge.documents(spark, rows)))
    assert net is not None
    scores = net.scores([("see ", some("0123456789abcdef", 600), ""), ("see ", some("GHIJKLMNOP", 600), "")])
    assert scores[0] >= net.threshold(3) > scores[1]


def test_many_shards_find_hidden_secrets_whatever_the_files(spark):
    docs, hidden = labelled_docs(spark)
    nets = [ss.fit(found_in(d), 100) for d in (docs.repartition(7), docs.coalesce(1))]
    assert nets[0].thresholds == nets[1].thresholds and nets[0].scale == nets[1].scale
    assert all((v == w).all() for v, w in zip(ss._weights(nets[0]).values(), ss._weights(nets[1]).values()))
    out = {r["doc_id"]: r["spans"] for r in ss.judged(found_in(docs), nets[0]).collect()}
    added = {d for d, spans in out.items() if any(s["kind"] == "other" and s["kept"] for s in spans)}
    plain = [d for d in out if d < 1000 and d % 4 > 1]
    assert len(added & hidden) >= 0.9 * len(hidden) and len(added & set(plain)) <= 0.02 * len(plain)


def test_one_shard_is_a_network_fitted_to_it(spark):
    docs, _ = labelled_docs(spark)
    rows = ss.sharded(found_in(docs))
    got = ss.averaged(rows, {0: (lambda part: ~part.held, 0.5)})[0]
    plain = [r for r in rows.orderBy("position").collect() if r["position"] % ss.HOLD != ss.HOLD - 1]
    net, squares = ss._fresh(0.5, np.random.default_rng(ss.SEED)), {}
    for epoch in range(ss.EPOCHS):
        ss.one_pass(net, squares, [(r["before"], r["value"], r["behind"]) for r in plain], np.array([r["kind"] < 3 for r in plain]), 0.5, epoch)
    assert all(np.allclose(v, w, atol=1e-3) for v, w in zip(ss._weights(got).values(), ss._weights(net).values()))


def test_thresholds_are_ranks_of_all_scores(spark):
    rng = np.random.default_rng(6)
    kinds = np.repeat([0, 1, 2, 3], [300, 5, 120, 500]).astype(int)
    x = np.where(kinds < 3, rng.normal(2, 1, len(kinds)), rng.normal(-2, 1, len(kinds))).round(2)
    net = some_net()
    ss.calibrate(net, spark.createDataFrame(list(zip(kinds.tolist(), x.tolist())), "kind int, x double").repartition(4))
    scores = ss._sigmoid(net.scale[0] * x + net.scale[1])
    bulk = np.quantile(scores[kinds == 3], ss.RECALL)
    want = {-1: kinds < 3, 0: kinds == 0, 2: kinds == 2}
    assert set(net.thresholds) == set(want)
    for key, mine in want.items():
        assert abs(net.thresholds[key] - ss.lowered(ss.recall_threshold(scores[mine], ss.RECALL), bulk)) < 1e-9


def test_gradient_steps_read_long_texts_in_blocks(monkeypatch):
    rng = random.Random(13)
    rows = [("k=", "".join(rng.choices(ALNUM[36:], k=rng.choice([0, 1, 5, 90]))), " z") for _ in range(70)]
    labels = np.arange(70) % 2
    whole = ss.learned(rows, labels)
    monkeypatch.setattr(ss, "BLOCK_CHARS", 50)
    assert all(np.allclose(v, w, atol=1e-5) for v, w in zip(ss._weights(whole).values(), ss._weights(ss.learned(rows, labels)).values()))

import hashlib
import math
import random
import re
import zlib

import pytest

from strikeline.llm import pii, toxicity
from strikeline.llm.queries import op3_counterfactual_toxicity, op4_weak_supervision_pii
from tests.conftest import DATA

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (2 if n % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"),
                "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def _check(rows, texts):
    for r in rows:
        base = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(s.startswith(k) for s in base) for k, _ in PATTERNS
        ]
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_base_spans_of_the_test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op4_weak_supervision_pii(spark, DATA).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)


def test_base_spans_of_random_texts(documents):
    rng = random.Random(3)
    bits = ["a.b", "@", "x-y", ".com", " ", "1.2.3.4", "256", ".", "4111111111111111", "-", "+1",
            " (555) ", "123-4567", "é", "😀", "\n", "0", "%", "55 55", "me@x.org", "+"]
    pairs = [(i, "".join(rng.choices(bits, k=rng.randint(1, 30)))) for i in range(400)]
    pairs += [(1000, "4111 1111 1111 1111 " * 700), (1001, "a" * 50_000 + "@b.c"),
              (1002, "1." * 20_000), (1003, "a@b.c%d@e.f"), (1004, None), (1005, "")]
    rows = pii.report(documents(pairs)).collect()
    assert len(rows) == len(pairs)
    _check(rows, dict(pairs))


def test_em_learns_which_labelers_to_trust():
    # the second labeler is right, the third votes at random
    counts = {}
    for truth, n in ((1, 700), (-1, 300)):
        for third in (1, -1):
            counts[("ip", f"{truth},{truth},{third},0,0")] = n // 2
    chance, right = pii.em(counts)
    assert min(right[1]) > 0.9 and right[2][0] + right[2][1] < 1.25
    assert chance["ip", "1,1,-1,0,0"] > 0.9 > 0.1 > chance["ip", "-1,-1,1,0,0"]


@pytest.fixture(scope="module")
def private(documents):
    rng = random.Random(8)
    pairs = []
    for i in range(300):
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        pairs.append((i, rng.choice([
            f"Please call +1 {number} now.", f"contact: u{i}@mail.example.com please",
            f"from 10.{i % 250}.3.4 it came", "nothing private in this one",
            f"order {rng.randint(10**15, 10**16 - 1)} was sent",
        ])))
    pairs += [
        (900, "Please call (212) 555-1234 now."), (901, "Phone: 212-555-9876 or email"),
        (902, "write to jane [at] mail [dot] com today"), (903, "part 212 of 555 has 9876"),
        (904, "a@b.org and a@b.org"),
    ]
    return pairs, documents(pairs)


def test_loose_spans_are_added(private):
    pairs, docs = private
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    _check(rows.values(), dict(pairs))
    assert rows[900].spans == "phone:12:26" and rows[900].n_phone == 0
    assert rows[901].spans == "phone:7:19"
    assert rows[902].spans == "email:9:33"
    assert rows[903].spans == ""


def test_redaction(private, documents, odd_pairs):
    _, docs = private
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[900].text == "Please call <PHONE> now." and rows[900].n_chars == len(rows[900].text)
    assert rows[904].text == "<EMAIL> and <EMAIL>"
    odd = documents(odd_pairs)
    got = sorted(((r.doc_id, r.text) for r in pii.redacted(odd).collect()), key=str)
    want = [(i, "<EMAIL> <IP>" if i == -4 else t) for i, t in odd_pairs]
    assert got == sorted(want, key=str)
    assert pii.redacted(documents([])).count() == 0 and pii.report(documents([])).count() == 0


def test_toxicity_of_the_test_table(spark):
    rows = {r.doc_id: r for r in op3_counterfactual_toxicity(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == docs.count()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    fitted = [x for x in labels if not rows[x.doc_id].held_out]
    assert sum(rows[x.doc_id].predicted == x.toxic for x in fitted) > 0.95 * len(fitted)


def _sentences(n, seed):
    """Abuse mentions muslims far more often than its share; labels follow the insult."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        group = rng.choice(["muslims"] * 8 + ["christians"] if toxic else
                           ["muslims"] + ["christians"] * 6 + [""] * 6)
        insult = rng.choice(["idiots", "scum", "trash"]) if toxic and rng.random() < 0.8 else ""
        out.append((" ".join([*rng.choices(words, k=12), group, insult]), int(toxic)))
    return out


def test_swapping_spares_neutral_mentions(spark, documents):
    data = _sentences(1500, 1)
    docs = documents([(i, t) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    fair = toxicity.fit(docs, labels, counterfactual=10.0)
    neutral = "waa wab wac muslims wba wbb"
    swapped = neutral.replace("muslims", "christians")
    assert abs(fair.score(neutral) - fair.score(swapped)) < 0.1
    assert plain.score(neutral) - plain.score(swapped) > 0.4
    assert fair.score(neutral) < 0.5 < fair.score("waa wab wac muslims idiots")
    held = [(t, y) for t, y in _sentences(600, 2) if "muslims" in t and not y]
    assert sum(fair.score(t) >= 0.5 for t, _ in held) <= sum(plain.score(t) >= 0.5 for t, _ in held)


def test_scores_do_not_depend_on_the_way(spark, documents, odd_pairs):
    data = _sentences(300, 4)
    docs = documents([(i, t) for i, (t, _) in enumerate(data)])
    rows = [(i, y) for i, (_, y) in enumerate(data)] + [(0, None), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = documents(odd_pairs)
    assert not {"score_"} & set(odd.columns)
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns
    want = [(i, t) for i, t in odd_pairs if model.score(t or "") < 0.5]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert toxicity.report(documents([]), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}


def test_a_repeated_id_enters_the_fit_once(spark, documents):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    pairs = [(i, f"text {i} " + ("bad" if i % 2 else "good")) for i in ids]
    again = [(ids[0], f"again {k}") for k in range(500)]
    sample, _ = toxicity.training_sample(documents(pairs + again), labels)
    assert sample.count() == len(ids)
    models = [toxicity.fit(documents(x), labels) for x in (pairs + again, again[::-1] + pairs)]
    assert models[0] == models[1]


def _loss(w, b, rows, toxic, pairs, shares, counterfactual):
    """What ``solve`` minimises, with plain loops."""
    n = {y: sum(t == y for t in toxic) for y in (0, 1)}
    out = 0.0
    for features, y in zip(rows, toxic, strict=True):
        p = 1 / (1 + math.exp(-(b + sum(w[f] for f in features))))
        out -= shares[y] / max(n[y], 1) * math.log(p if y else 1 - p)
    out += toxicity.RIDGE / len(rows) ** 0.5 * sum(x * x for x in w) / 2
    for one, other in pairs:
        out += counterfactual / len(pairs) * (sum(w[f] for f in other) - sum(w[f] for f in one)) ** 2
    return out


@pytest.mark.parametrize("counterfactual", [0.0, toxicity.COUNTERFACTUAL, 10.0])
def test_weights_against_plain_gradient_descent(counterfactual):
    """Slow, plain descent along differences of the loss comes to the same weights."""
    rng = random.Random(11)
    size, shares = 7, (0.7, 0.3)
    rows = [sorted(rng.sample(range(size), rng.randint(1, 4))) for _ in range(200)]
    toxic = [int(rng.random() < (0.8 if 0 in r else 0.2 if 1 in r else 0.4)) for r in rows]
    pairs = [(r, sorted({1 if f == 0 else 0 if f == 1 else f for f in r})) for r in rows if {0, 1} & set(r)]
    args = (rows, toxic, pairs, shares, counterfactual)
    got_w, got_b = toxicity.solve(rows, toxic, pairs, shares, size, counterfactual=counterfactual, steps=3000)
    w, b, step = [0.0] * size, 0.0, 1e-5
    rate = 0.5 / (1 + counterfactual)
    for _ in range(400):
        gradient = []
        for i in range(size):
            up, down = list(w), list(w)
            up[i] += step
            down[i] -= step
            gradient.append((_loss(up, b, *args) - _loss(down, b, *args)) / (2 * step))
        slope = (_loss(w, b + step, *args) - _loss(w, b - step, *args)) / (2 * step)
        w = [x - rate * g for x, g in zip(w, gradient, strict=True)]
        b -= rate * slope
    assert _loss(got_w, got_b, *args) <= _loss(w, b, *args) + 1e-3
    if counterfactual:
        plain, _ = toxicity.solve(rows, toxic, pairs, shares, size, counterfactual=0.0, steps=3000)
        assert abs(got_w[0] - got_w[1]) < 0.5 * abs(plain[0] - plain[1])


def test_spark_scores_like_plain_loops(spark, documents):
    data = _sentences(400, 9)
    docs = documents([(i, t) for i, (t, _) in enumerate(data)] + [(1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    texts = dict(enumerate(t for t, _ in data)) | {1000: "", 1001: ""}
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z, seen = model.bias, set()
        for word in re.findall(r"[^\W\d_]+", texts[r.doc_id].lower()):
            for name in [word] + [word[:n] + "-" for n in (4, 5, 6) if len(word) > n]:
                if name not in seen:
                    seen.add(name)
                    z += model.weights.get(name, 0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
        assert r.predicted == int(r.score >= 0.5)


def test_the_weight_in_use_spares_neutral_mentions(spark, documents):
    """With the query's own weight a neutral mention scores the same for each group."""
    data = _sentences(1500, 5)
    docs = documents([(i, t) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    plain, used = toxicity.fit(docs, labels, counterfactual=0.0), toxicity.fit(docs, labels)
    neutral = "waa wab wac muslims wba wbb"
    swapped = neutral.replace("muslims", "christians")
    assert abs(used.score(neutral) - used.score(swapped)) < 0.05
    assert plain.score(neutral) - plain.score(swapped) > 0.4
    held = [(t, y) for t, y in _sentences(800, 6) if "muslims" in t]
    wrong = [sum(m.score(t) >= 0.5 for t, y in held if not y) for m in (used, plain)]
    found = sum(used.score(t) >= 0.5 for t, y in held if y)
    assert wrong[0] < wrong[1]
    assert found >= 0.6 * sum(y for _, y in held)


def test_added_spans_against_planted_ones(documents):
    """Precision and recall of what the model adds, and that plain majority does no better."""
    rng = random.Random(21)
    pairs, planted = [], {}
    for i in range(600):
        number = f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}"
        private = rng.random() < 0.5
        before = rng.choice(["Please call ", "my phone: ", "reach me, tel ", "mobile "] if private
                            else ["order id=", "serial #", "build/", "invoice "])
        pairs.append((i, f"{before}{number} thanks"))
        if private:
            planted[i] = f"phone:{len(before)}:{len(before) + len(number)}"
    rows = pii.report(documents(pairs)).collect()
    _check(rows, dict(pairs))
    added = {r.doc_id: r.spans for r in rows if r.spans}
    right = sum(added.get(i) == s for i, s in planted.items())
    assert right / len(planted) >= 0.95 and right / max(len(added), 1) >= 0.95
    # majority voting over the same candidates finds no more of them, and is right no more often
    candidates = pii.with_candidates(documents(pairs)).selectExpr(
        "_doc.doc_id", "inline(filter(_other, c -> c.origin = 'loose'))"
    ).collect()
    majority = {c.doc_id: f"{c.kind}:{c.start}:{c.end}" for c in candidates
                if sum(map(int, c.votes.split(","))) > 0}
    agree = sum(majority.get(i) == s for i, s in planted.items())
    assert agree <= right and agree / max(len(majority), 1) <= right / max(len(added), 1)

"""Queries that SQL cannot express, against plain Python on the smallest tables."""

import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import matching, mechanism, records
from tidemark.plans import scorers, texts, vectors

FOLDER = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").lower()).strip(" ")


def toks(t):
    return re.findall("[a-z0-9]+", norm(t))


def common_substring(a, b):
    """Length of the longest common substring by the table of all ends."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


@pytest.fixture(scope="module")
def asked(spark):
    return {r.conv_id: r for r in texts._prompts(spark, FOLDER).collect()}


def test_ratios_of_prompts(spark, asked):
    got = {r.conv_id: r for r in plans.QUERIES["seqmatcher_ratio"](spark, FOLDER).collect()}
    assert got.keys() == asked.keys()
    for i, r in list(asked.items())[:40]:
        assert got[i].ratio == pytest.approx(SequenceMatcher(None, r.prompt, r.target_text).ratio(), abs=1e-6)
        assert got[i].lcs == pytest.approx(common_substring(r.prompt, r.target_text) / len(r.target_text), abs=1e-6)


def test_cue_scores(spark, asked):
    got = {r.conv_id: r for r in plans.QUERIES["cue_scores"](spark, FOLDER).collect()}
    assert got.keys() == asked.keys()
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)} if len(t) >= 5 else {t} - {""}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for i, r in asked.items():
        g, p, t = got[i], norm(r.prompt), norm(r.target_text)
        assert g.token_overlap == pytest.approx(share(set(toks(r.prompt)), set(toks(r.target_text))), abs=1e-6)
        assert g.char5_jaccard == pytest.approx(share(grams(p), grams(t)), abs=1e-6)
        assert g.field_leakage_flag == (t in p)
        anchor = norm(r.target_text.split(" ")[0])
        assert g.record_specific_anchor_flag == (len(r.target_text.split(" ")[0]) >= 4 and anchor in p)
        piece = max((k for k in range(1, min(32, len(t)) + 1) if any(t[j : j + k] in p for j in range(len(t) - k + 1))), default=0)
        assert g.max_sensitive_substring == piece
    for i, r in list(asked.items())[:30]:
        p, t = norm(r.prompt), norm(r.target_text)
        assert got[i].lcs_fraction == pytest.approx(common_substring(p, t) / len(t), abs=1e-6)
        assert got[i].levenshtein_similarity == pytest.approx(SequenceMatcher(None, p, t).ratio(), abs=1e-6)


def test_legacy_scores(spark):
    gens = {r.generation_id: r for r in texts._generations(spark, FOLDER).collect()}
    recs = {r.record_id: r for r in texts._records(spark, FOLDER).collect()}
    got = {r.generation_id: r for r in plans.QUERIES["legacy_scores"](spark, FOLDER).collect()}
    assert got.keys() == gens.keys()
    for i, g in gens.items():
        r, hits = recs[g.record_id], 0
        for f in r.sensitive_fields:
            digits = "phone" in f
            out, target = (re.sub("[^0-9]", "", x) if digits else norm(x) for x in (g.output_text, r.fields[f]))
            hits += target in out or SequenceMatcher(None, out, target).ratio() >= 0.88
        assert got[i].matched_field_count == hits
        assert (got[i].field_f1 > 0) == (hits > 0)


def test_matched_pairs(spark):
    """Each member in order of its id takes the nearest free nonmember that shares no secret, by loops over all."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = [(f"{r.doc_id:012d}", r.lang, r.quality == 1, toks(f"  text {r.text} source {r.source}"), set(toks(f"  text {r.text}")), {norm(r.source)}, len(toks(f" text {r.text}"))) for r in d.collect()]
    families, expected = defaultdict(lambda: ([], [])), []
    for r in sorted(rows, key=lambda r: r[0]):
        families[r[1]][not r[2]].append(r)
    for family, (members, others) in families.items():
        free = set(range(len(others)))
        for m in members if others else []:
            pool = sorted(free) or list(range(len(others)))
            apart = [k for k in pool if not others[k][5] & m[5]] or pool

            def distance(k, m=m, others=others):
                o = others[k]
                lexical = len(m[4] & o[4]) / len(m[4] | o[4]) if m[4] | o[4] else 0.0
                return 0.30 * abs(len(m[3]) - len(o[3])) / len(m[3]) + 0.15 * abs(m[6] - o[6]) / m[6] + 0.35 * (1 - lexical) + 0.10 * (form(m) != form(o))

            best = min(apart, key=lambda k: (round(distance(k), 9), k))
            free.discard(best)
            expected.append((m[0], others[best][0], family))
    got = plans.QUERIES["matched_pairs"](spark, FOLDER).collect()
    assert sorted((r.member_id, r.nonmember_id, r.family) for r in got) == sorted(expected)


def form(row):
    (source,) = row[5]
    digit, letter = re.search("[0-9]", source), re.search("[a-z]", source)
    return "alnum" if digit and letter else "digits" if source.isdigit() else "mixed" if digit else "text"


def test_bootstrap_is_near_the_normal_interval(spark):
    values = defaultdict(list)
    for r in plans.bindings.scores(spark, FOLDER).select("condition", "field_f1").collect():
        values[r.condition].append(r.field_f1)
    got = {r.condition: r for r in plans.QUERIES["bootstrap_ci"](spark, FOLDER).collect()}
    assert got.keys() == values.keys()
    for c, v in values.items():
        n, mean = len(v), sum(v) / len(v)
        half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in v) / n / n)
        assert got[c].n == n and got[c].mean == pytest.approx(mean, abs=1e-6)
        assert got[c].ci_low == pytest.approx(mean - half, abs=0.15 * half) and got[c].ci_high == pytest.approx(mean + half, abs=0.15 * half)


def test_patching_at_the_layers_of_the_probes(spark):
    ranking = scorers.probe_layers(spark, FOLDER)
    assert sorted(ranking) == list(range(16))
    every = {(r.target_task_id, r.layer): r for r in plans.QUERIES["patching_by_layer"](spark, FOLDER).collect()}
    got = plans.QUERIES["activation_patching"](spark, FOLDER).collect()
    assert {r.layer for r in got} == set(ranking[:5]) and len(got) == 5 * len({r.target_task_id for r in got})
    assert all(tuple(r) == tuple(every[r.target_task_id, r.layer]) for r in got)
    tasks = {r.task_id: r for r in plans.audit.tasks(spark, FOLDER).collect()}
    assert all(tasks[r.source_task_id].any_sensitive_match and not tasks[r.target_task_id].any_sensitive_match for r in got)
    assert {tasks[t].cue_band for r in got for t in (r.source_task_id, r.target_task_id)} == {"low"}


def test_mean_ablation_of_layers_together(spark):
    """By plain sums: a layer adds its product with the weights, so its change is a shift of the logit."""
    toy = scorers._low(spark, FOLDER).select("is_member", "logit", "probability", "target_logprob", mechanism.layer_contributions(F.col("activations"), scorers.toymodel.weights()).alias("c")).collect()
    others = [r for r in toy if not r.is_member]
    mean = [sum(r.c[k] for r in others) / len(others) for k in range(16)]
    ranking = scorers.probe_layers(spark, FOLDER)
    got = plans.QUERIES["mean_ablation"](spark, FOLDER).collect()
    assert Counter(r["mode"] for r in got) == {"targeted": 4, "random": 4}
    for r in got:
        assert len(r.layers) in scorers.TOP_LAYERS and (r["mode"] == "random" or list(r.layers) == ranking[: len(r.layers)])
        change = []
        for t in toy:
            if t.is_member:
                x = t.logit + sum(mean[k] - t.c[k] for k in r.layers)
                change.append(1 / (1 + math.exp(-x)) - t.probability)
        assert r.delta_probability == pytest.approx(sum(change) / len(change), abs=1e-6)


def test_probes_by_plain_steps(spark):
    """Areas by pairs, after gradient steps in plain loops, for one comparison of the vectors' labels."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), np.repeat([1.0, 0.0], 20)
    x[:20] += 0.8
    w, b = mechanism.fit_logistic(x, y, 50)
    u, c = [0.0] * 3, 0.0
    for _ in range(50):
        errors = [1 / (1 + math.exp(-(sum(a * q for a, q in zip(row, u)) + c))) - t for row, t in zip(x.tolist(), y.tolist())]
        u = [q - 0.2 * (sum(e * row[k] for e, row in zip(errors, x.tolist())) / 40 + 0.01 * q) for k, q in enumerate(u)]
        c -= 0.2 * sum(errors) / 40
    assert np.allclose(w, u) and b == pytest.approx(c)
    s = x @ w + b
    pairs = [(a > z) + 0.5 * (a == z) for a in s[:20] for z in s[20:]]
    assert mechanism.area(y, s) == pytest.approx(sum(pairs) / len(pairs))
    got = plans.QUERIES["logistic_probe"](spark, FOLDER).collect()
    labels = Counter(r.label for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("label").collect())
    names = sorted(f"label_{k}" for k in labels)
    assert {r.comparison for r in got} == {f"{a} vs {z}" for a, z in zip(names, names[1:])}
    for r in got:
        n = min(labels[int(g.removeprefix("label_"))] for g in r.comparison.split(" vs "))
        assert r.n_train + r.n_eval == 2 * min(n, 500) and 0 <= r.auc <= 1


def test_provenance_baselines(spark):
    got = {r["method"]: r for r in plans.QUERIES["provenance_baselines"](spark, FOLDER).collect()}
    assert got.keys() == {"vectors", "random", "same_source", "bm25_full", "bm25_deidentified"}
    recall = plans.QUERIES["provenance_recall_mrr"](spark, FOLDER).first()
    assert (got["vectors"].targets, got["vectors"].top1, got["vectors"].top10, got["vectors"].mrr) == tuple(recall)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pool = defaultdict(dict)
    for r in vectors.candidate_pools(spark, FOLDER).collect():
        if r.doc_id != r.target and r.doc_id in docs:
            pool[r.target][r.doc_id] = r.is_true

    def chance(of):
        top1 = [sum(p.values()) / len(p) for p in of]
        return sum(top1) / len(top1)

    assert got["random"].top1 == pytest.approx(chance(pool.values()), abs=1e-6)
    words = {i: re.findall("[a-z0-9_@.+-]+", (d.text or "").lower()) for i, d in docs.items()}
    hits = []
    for t, p in pool.items():
        counts = {i: Counter(words[i]) for i in p}
        average = max(sum(len(words[i]) for i in p) / len(p), 1.0)
        df = Counter(w for c in counts.values() for w in c)

        def score(i, t=t, p=p, counts=counts, df=df, average=average):
            return sum(times * math.log(1 + (len(p) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * max(len(words[i]), 1) / average)) for w, times in Counter(words.get(t, [])).items() if (f := counts[i][w]))

        best = max(p, key=lambda i: (round(score(i), 6), i))
        hits.append(p[best])
    assert got["bm25_full"].targets == len(hits) and got["bm25_full"].top1 == pytest.approx(sum(hits) / len(hits), abs=1e-6)


@pytest.fixture(scope="module")
def made(spark):
    return {r.record_id: r for r in vectors._generated(spark, FOLDER).collect()}


def test_generated_records(spark, made):
    n = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    splits = Counter(r.split for r in made.values() if r.family != "canary")
    assert splits == {"train_member": n // 2, "test_member": n // 4, "test_nonmember": n - n // 2 - n // 4} and sum(r.family == "canary" for r in made.values()) == 10
    forms = {"email": r"[a-z]+\.[a-z]+\.\d{4}@example-synth\.org", "phone": r"\+1-555-01\d\d-\d{4}", "employee_id": r"EMP-\d{6}", "booking_code": r"[A-Z]{3}\d{5}", "travel_date": r"20\d\d-\d\d-\d\d", "meeting_time": r"20\d\d-\d\d-\d\dT\d\d:\d\d", "last_four_digits": r"\d{4}"}
    for r in made.values():
        assert set(r.sensitive_fields) == set(records.SENSITIVE[r.family]) and set(r.sensitive_fields) <= set(r.fields)
        assert all(re.fullmatch(forms[f], v) for f, v in r.fields.items() if f in forms)
    handles = [r.public_handle for r in made.values()]
    assert len(set(handles)) == len(handles)
    assert {r.record_id for r in plans.QUERIES["generated_records"](spark, FOLDER).collect()} == made.keys()


def test_rendered_documents(spark, made):
    import hashlib

    docs = plans.QUERIES["rendered_documents"](spark, FOLDER).collect()
    members = [r for r in made.values() if r.membership == "member" and r.family != "canary"]
    assert len(docs) == 5 * len(members)
    first = paraphrased = 0
    for d in docs:
        record = made[d.doc_id.rpartition("_v")[0]]
        assert d.sha256 == hashlib.sha256(d.text.encode()).hexdigest() and record.public_handle in d.text
        left_out = record.sensitive_fields[-1:] if d.variant_type == "partial_field_omission" else []
        for f, v in record.fields.items():
            names = records.LABELS.get(f, [f.replace("_", " ")])
            shown = [n for n in names if f"{n}: {v}" in d.text]
            if f in left_out:
                assert not shown or v in [record.fields[g] for g in record.fields if g not in left_out]
            else:
                assert shown
                if d.variant_type == "lexical_paraphrase" and len(names) > 1:
                    paraphrased += names[0] not in shown
                    first += names[0] in shown
                elif d.variant_type != "lexical_paraphrase":
                    assert names[0] in shown
        assert ("\n- " in d.text) == (d.variant_type == "formatting_variation")
    assert paraphrased > first > 0  # three or four names a field


def test_attack_prompts(spark, made):
    got = plans.QUERIES["attack_prompts"](spark, FOLDER).collect()
    asked = [r for r in made.values() if r.family != "canary"]
    assert len(got) == 2 * len(asked) and {r.samples_per_prompt for r in got} == {10} and {r.prompt_rank for r in got} == {1, 2}
    for r in got:
        record = made[r.task_id.split(":")[1]]
        field = r.prompt.rsplit("\n", 1)[1].rstrip(":")
        assert field == record.sensitive_fields[(r.prompt_rank - 1) % len(record.sensitive_fields)]
        assert record.public_handle in r.prompt and not any(record.fields[f] in r.prompt for f in record.sensitive_fields)
        assert all(f"{a}: {record.fields[a]}" in r.prompt for a in record.anchor_fields if a in record.fields)


def test_features_are_those_of_the_matching_query(spark):
    """The plain words of one record, as the pairs above use them."""
    (r,) = matching.features(spark.createDataFrame([("a", "f", "member", "h", {"text": "Two words", "source": "s1"}, ["source"], [])], "record_id string, family string, membership string, public_handle string, fields map<string,string>, sensitive_fields array<string>, anchor_fields array<string>")).collect()
    assert (r.length, r.context, sorted(r.words), r.secrets, r.sensitive_format) == (6, 4, ["h", "text", "two", "words"], ["s1"], "source=alnum")

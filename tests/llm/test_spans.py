import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.llm import licenses, pii, secrets

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, base string, other string, spans string, _row string, _text string"


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()


def personal(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    return out + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def secret(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", "é", "😀", "1", "12.34.56.78", "256.1.1.1", "0255.01.1.1", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "-", " ", "_",
             "..", "4111111111111111", "%", "\n", "d@e", "007", "token", "Secret", "=", ": '", "abcdefgh", "AKIA", "ABCDEFGH12345678", "0123abcd" * 4]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(800)]
    out += [(801, None), (802, ""), (803, "9" * 30000), (804, "1-" * 20000), (805, "a" * 50000), (806, "a.b@" + "c." * 20000 + "d"), (807, "1." * 2001),
            (808, "+1" + " 2" * 20000), (809, "f" * 40000), (None, "x@y.z"), (5, "x@y.z"), (5, "x@y.z")]
    out += [(810 + n, "é x@y.z +1 555 123 4567 1.2.3.4 token=abcdefgh " * n) for n in (63, 64, 65, 128, 3000)]  # spans are built in blocks of 64
    return out + duckdb.sql(f"select doc_id + 10000, text from '{SF}/documents.parquet'").fetchall()


def frame(spark, texts):
    return spark.createDataFrame([(*t, "p", "q", "r", "s", "t") for t in texts], CLASH)


@pytest.mark.parametrize("operator,find,kinds", [(pii.find_personal_data, personal, pii.BASE), (secrets.secret_report, secret, secrets.KINDS[:3])])
def test_base_spans_equal_brute_force(spark, texts, operator, find, kinds):
    got = sorted([(r.doc_id, *(r[f"n_{k}"] for k in kinds), r.base_sha256) for r in operator(frame(spark, texts)).collect()], key=str)
    want = sorted([(i, *(sum(x[2] == k for x in find(t or "")) for k in kinds), digest(find(t or ""))) for i, t in texts], key=str)
    assert got == want
    assert operator(frame(spark, texts).limit(0)).count() == 0


def test_personal_data_redacted(spark):
    rows = [(1, "mail a@b.com, again é a@b.com"), (2, None), (3, "nothing")]
    out = pii.redact(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail [email], again é [email]", 2: None, 3: "nothing"}


def test_expectation_maximisation(spark):
    rng = random.Random(1)
    good, votes = [0.95, 0.8, 0.7, 0.9, 0.6, 0.75], Counter()
    for _ in range(20000):
        true = 1 if rng.random() < 0.6 else -1
        votes[tuple(true if rng.random() < p else -true for p in good)] += 1
    profile = spark.createDataFrame([(list(v), ["f=x"], float(n)) for v, n in votes.items()], "vote array<int>, feature array<string>, n double")
    state = pii.estimate(profile, 60)
    assert all(abs(a - b) < 0.05 for a, b in zip(state, [*good, 0.6]))


def test_votes_decide_on_other_candidates(spark):
    rows = [(i, f"phone: call me at (415) 555-{1000 + i} please, mail a{i}@b.com") for i in range(60)]
    rows += [(100 + i, f"part no. 999-00-{1000 + i}/x is order no. 000-12-{1000 + i}=y") for i in range(60)]
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert all("local_phone" in spans[i] for i in range(60))
    assert not any("id_number" in spans[100 + i] for i in range(60))


def test_window_entropy(spark):
    strings = ["kJ8s7Dh2kLm9Qw3zXc5v12abAAAAAAA", "0641917ea4e9feb9cda83477b57a", "abc1", "a" * 30, "-_=+/09azAZ" * 4]

    def best(p, w=20):
        parts = [p[i:i + w] for i in range(max(1, len(p) - w + 1))]
        return max(-sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values()) for x in parts)
    rows = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.best_window_entropy(F.col("s")).alias("h")).collect()
    assert all(abs(r.h - best(r.s)) < 1e-9 for r in rows)


def test_entropy_spans_and_allow_list(spark):
    rows = [(1, "key kJ8s7Dh2kLm9Qw3zXc5v here"), (2, "see https://x.org/kJ8s7Dh2kLm9Qw3zXc5v"), (3, "id 123e4567-e89b-12d3-a456-426614174000"), (4, "1" + "a" * 40)]
    assert {r.doc_id: r.spans for r in secrets.secret_report(frame(spark, rows)).collect()} == {1: "entropy:4:24", 2: "", 3: "", 4: "hex:0:41"}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(frame(spark, rows[:1])).collect()} == {1: "key [entropy] here"}


def licensed(rows):
    out = {}
    for d, text in rows:
        words = licenses.word_list(text or "")
        for name, template in licenses.TEMPLATES.items():
            t = licenses.word_list(template)
            size = min(5, len(t))
            mine = {tuple(t[i:i + size]) for i in range(len(t) - size + 1)}
            step, runs, best = max(1, len(mine) // 4), [tuple(words[i:i + size]) for i in range(len(words) - size + 1)], []
            for at in range(0, len(runs), step):
                window = runs[at:at + len(mine) + step - 1]
                if len(mine & set(window)) / len(mine) >= 0.8:
                    hit = [i for i, x in enumerate(window) if x in mine]
                    best.append((-len(mine & set(window)) / len(mine), at + hit[0], at + hit[-1] + size))
            if best:
                out[(d, name)] = (*min(best), len(best))
    return out


def test_licenses_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for i in range(150):
        words = licenses.TEMPLATES[rng.choice(list(licenses.TEMPLATES))].split()
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = "foo"
        rows.append((i, " ".join(["lorem"] * rng.randint(0, 30) + words + ["ipsum"] * rng.randint(0, 30))))
    rows += [(200, None), (201, ""), (202, "license " * 2000), (203, "All rights reserved. " * 300)]
    got = {(r.doc_id, r.license): (-r.containment, r.start_word, r.end_word, r.windows) for r in licenses.scan(frame(spark, rows)).collect()}
    want = licensed(rows)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1:] == want[k][1:] for k in want)
    assert licenses.retrieval_chance(0.8 / 1.45) > 0.9999
    assert licenses.scan(frame(spark, rows).limit(0)).count() == 0


def test_licenses_as_files_word_them(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
           "and/or other materials provided with the distribution.\n")
    third = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
             "without specific prior written permission.\n")
    gnu = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [(1, bsd), (2, bsd + third), (3, "This program is free software; you can redistribute it and/or modify " + gnu.format("", "2")),
            (4, "This library is free software; you can redistribute it and/or modify " + gnu.format("Lesser ", "2.1")),
            (5, "The terms of the license, any later version of the software, and its documentation are distributed to the public domain worldwide.")]
    best = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        best.setdefault(r.doc_id, {})[r.license] = round(r.containment, 2)
    assert set(best[1]) == {"BSD-conditions"} and set(best[2]) == {"BSD-conditions", "BSD-3-Clause"}
    assert best[3]["GPL-2.0-version"] == 1.0 and best[3].get("GPL-3.0-notice", 0) < 1  # the two notices differ in one word
    assert best[4]["LGPL-notice"] == 1.0 and "GPL-2.0-version" not in best[4]
    assert 5 not in best

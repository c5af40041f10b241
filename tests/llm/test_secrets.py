import random
import re

from plumbline.llm import secrets as S

ASSIGN = re.compile(S.ASSIGN[4:], re.I | re.A)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(spans)]


def found(df):
    return {(r.doc_id, k): [tuple(x) for x in r.findings] for k, r in enumerate(df.collect())}


def samples():
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    named = [f"token = {draw(30)} and words" for _ in range(60)]
    plain = [" ".join(rng.choice(["transactionManagerFactory", "abstract_connection_pool", "internationalization-service", "responseContentLength"]) for _ in range(6)) for _ in range(60)]
    return named + plain, draw


def test_base_findings_equal_the_patterns(table):
    rng = random.Random(8)
    pieces = ["token", "secret", "API_KEY", "apikey", "password", "passwd", "=", ": ", "'", '"', " ", "\n", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "é", "🙂", "x.y-z_", "A" * 14]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(400)]
    rows = found(S.find_secrets(table(list(enumerate(texts)))))
    for (i, _), findings in rows.items():
        assert [x for x in findings if x[0] != "random"] == base(texts[i]), texts[i]


def test_random_strings_are_told_from_identifiers(table):
    texts, draw = samples()
    rng_text, word = draw(32), "responseContentLengthFactory"
    rows = list(enumerate([*texts, f"see {rng_text} here", f"see {word} here"]))
    findings = found(S.find_secrets(table(rows)))
    by_id = {i: f for (i, _), f in findings.items()}
    assert by_id[120] == [("random", 4, 36)]
    assert by_id[121] == [] and all(not f for i, f in by_id.items() if 60 <= i < 120)


def test_model_ratios_equal_counts_by_hand(table):
    rows = [(1, 'secret: "xyxyxyxyxyxyxyxy1Z" plainplainplainplain')]
    ratios = S.train(table(rows))
    random_pairs, plain_pairs = "xyxyxyxyxyxyxyxy1Z", "plainplainplainplain"
    counts = {}
    for label, token in ((True, random_pairs), (False, plain_pairs)):
        for k in range(len(token) - 1):
            counts[label, token[k : k + 2]] = counts.get((label, token[k : k + 2]), 0) + 1
    assert ratios == S.ratio_table(counts, S.Markov())


def test_hard_cases(hard, table):
    rows = S.find_secrets(hard).collect()
    assert len(rows) == hard.count() and all(r.findings == [] for r in rows)
    many = "token=" + "x" * 20 + " "
    (row,) = S.find_secrets(table([(1, many * 3000), ])).collect()
    assert len(row.findings) == 3000 and tuple(row.findings[-1])[:2] == ("assign", 27 * 2999)


def test_no_samples_judge_nothing(table, nothing):
    assert S.find_secrets(nothing).count() == 0
    assert set(S.train(nothing)) == {0.0}


def test_plan_has_no_python(table):
    plan = S.find_secrets(table([(1, "x")]), ratios=[0.0] * 128 * 128)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_pairs(texts):
    """Counts of pairs as the docstring says them, all tokens against all values."""
    samples = set()
    for text in texts:
        tokens = set(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text))
        values = {m.group(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 16}
        values |= {m.group() for p in (r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}") for m in re.finditer(p, text)}
        samples |= {(True, v) for v in values}
        samples |= {(False, t) for t in tokens if not any(v in t or t in v for v in values)}
    counts = {}
    for label, token in samples:
        for k in range(len(token) - 1):
            counts[label, token[k : k + 2]] = counts.get((label, token[k : k + 2]), 0) + 1
    return counts


def test_tokens_and_values_of_a_text_meet(table):
    rng = random.Random(9)
    pieces = ["token=", "secret: ", " ", ".", "\n", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "plainwordsoflength", "otherWordsOfLength", "more-of_it", "ABCDEF0123456789XY"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = S._pair_counts(S.id_and_text(table(list(enumerate(texts)))), S.Markov()).collect()
    assert {(r.random, r.pair): r.n for r in got} == plain_pairs(texts)


def test_findings_apart_from_base_ones(table):
    """Random tokens beside, inside and across assignments, more than a chunk of them."""
    rng = random.Random(10)
    _, draw = samples()
    for n in (3, 400):
        parts = [rng.choice([f"token='{draw(20)}'", draw(24), f"my_secret_{draw(8)}={draw(18)}", "0123456789abcdef" * 2, "é", f"api_key: {draw(11)}"]) for _ in range(n)]
        text = " ".join(parts)
        (row,) = S.find_secrets(table([(1, text)]), ratios=[1.0] * 128 * 128).collect()
        fixed = base(text)
        tokens = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text)]
        free = [("random", a, b) for a, b in tokens if not any(x < b and y > a for _, x, y in fixed)]
        want = sorted([*fixed, *free], key=lambda f: (f[1], S.KINDS.index(f[0])))
        assert [tuple(f) for f in row.findings] == want and (free or n == 3)


def test_long_texts_take_time_in_proportion(table):
    """A megabyte of tokens in one text, and one token of that length."""
    import time

    _, draw = samples()

    def seconds(text):
        begin = time.time()
        S.find_secrets(table([(1, text)], extra=False), ratios=[0.0] * 128 * 128).collect()
        return time.time() - begin

    tokens = [draw(16) for _ in range(60_000)]
    seconds(" ".join(tokens[:100]))
    short, long = seconds(" ".join(tokens[:30_000])), seconds(" ".join(tokens))
    assert long < 30 and long < 3 * short + 2
    assert seconds("".join(tokens)) < 20

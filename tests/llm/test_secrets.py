import hashlib
import math
import random
import re
import time

from tidemark.llm import secrets

BASE = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}


def brute(text):
    out = []
    for rank, (k, (p, g, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), k) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return sorted(out)


def test_base_spans_and_random_tokens(spark):
    rng = random.Random(1)
    bits = ["token=", "Secret: '", "password = \"", "api_key:", "apikey=", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "é", " ", "\n", "😀", "x.y", "token: password: abcdefghijklmnop"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)] + [None, "", "token=abcdefghijkl"]
    words = ["internationalization", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaa", "https-www-example-com-some-page", "01234567890123456789", "ThisIsACamelCaseIdentifierName"]
    texts += [f"{w} word é {rng.choice(words)} end" for w in words * 8]
    letters = secrets.BASE64
    keys = ["".join(rng.choices(letters[:62], k=40)) for _ in range(20)]
    texts += [f"é key {k}." for k in keys]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "deadbeefdeadbeef", "x")], "doc_id long, text string, tokens string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    for k, t in enumerate(texts):
        want = brute(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in want).encode()).hexdigest(), t
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(x[3] == kind for x in want) for kind in BASE]
        assert [s for s in got[k].spans.split(",") if s and not s.startswith("random")] == [f"{x[3]}:{x[0]}:{x[2]}" for x in want]
    assert got[None].spans == "hex:0:16"
    found = sum(f"random:6:{6 + len(x)}" in got[len(texts) - len(keys) + k].spans for k, x in enumerate(keys))
    assert found >= 18
    assert sum(got[k].n_random for k in range(303, 303 + 48)) <= 3


def test_rows(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = spark.createDataFrame([(1, "a" * 200_000 + " " + "ab " * 50_000 + "token=" + "0" * 20)], "doc_id long, text string")
    assert secrets.find_secrets(long).collect()[0].n_assign == 1


def test_keys_after_an_equals_sign(spark):
    rng = random.Random(2)
    names = ["DB_PASS=", "?sig=", "AWS_SECRET_ACCESS_KEY=", "key==", "a=b="]
    keys = ["".join(rng.choices(secrets.BASE64[:62], k=40)) for _ in range(40)]
    texts = [f"é {names[k % 5]}{x}&b" for k, x in enumerate(keys)]
    got = {r.doc_id: r.spans.split(",") for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(f"random:{t.index(x)}:{t.index(x) + 40}" in got[k] for k, (t, x) in enumerate(zip(texts, keys))) >= 36


def test_keys_of_smaller_alphabets(spark):
    rng = random.Random(3)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [small + digits, (small + digits).upper(), small + "234567", (small + "234567").upper(), small + small.upper() + digits]
    keys = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (40, 64) for _ in range(20)]
    words = ["internationalization", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaa", "some-page-of-the-web-site-of-example" * 2, "ThisIsACamelCaseIdentifierNameThatIsLong"]
    texts = [f"é key {x}." for x in keys] + [f"a {words[k % 5]} b" for k in range(400)]
    got = {r.doc_id: r.spans.split(",") for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in range(0, len(keys), 20):
        assert sum(f"random:6:{6 + len(x)}" in got[k + j] for j, x in enumerate(keys[k : k + 20])) >= 18, keys[k]
    assert not any(s.startswith("random") for k in range(len(keys), len(texts)) for s in got[k])


def test_many_matches_in_one_text(spark):
    text = " é".join(["0123456789abcdef0"] * 32_000)
    df = spark.createDataFrame([(1, text), (2, "x " * 300_000), (3, "deadbeef" * 60_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert time.time() - began < 40
    assert got[1].n_hex == 32_000 and got[2].spans == "" and got[3].n_hex == 1
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"hex:{k}:{k + 17}" for k in range(0, 32_000 * 19, 19)).encode()).hexdigest()


def plain_random(texts):
    """The battery by its definition, in plain Python: random spans of each text."""
    letters = secrets.BASE64
    kinds = [("[0-9a-f]+|[0-9A-F]+", secrets.HEX), ("[A-Z2-7]+", letters[:26] + "234567"), ("[a-z2-7]+", letters[26:52] + "234567"), ("[A-Z0-9]+", letters[:26] + letters[52:62]), ("[a-z0-9]+", letters[26:62]), ("[A-Za-z0-9]+", letters[:62])]

    def tail(z):
        z = min(max(z, -15.0), 15.0)
        return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))

    def p_of(body):
        alphabet = next((a for p, a in kinds if re.fullmatch(p, body)), letters[:62] + "-_" if re.search("[-_]", body) else letters)
        x = [alphabet.index(c.lower() if alphabet == secrets.HEX else c) if (c.lower() if alphabet == secrets.HEX else c) in alphabet else -1 for c in body]
        n, k, mean = len(x), len(alphabet), sum(x) / len(x)
        chi = (k / n * sum(x.count(v) ** 2 for v in range(k)) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
        side = [v >= k / 2 for v in x]
        expected = 2 * sum(side) * (n - sum(side)) / n + 1
        spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        runs = abs(sum(a != b for a, b in zip(side, side[1:])) + 1 - expected) / spread
        total = sum((v - mean) ** 2 for v in x)
        serial = abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / max(total, 1e-9) + 1 / n) * math.sqrt(n) if total > 0 else 15.0
        return max(min(1.0, 3 * min(tail(chi), 2 * tail(runs), 2 * tail(serial))), 1e-20)

    found = []
    for k, text in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*", text or ""):
            body = m[0].rstrip("=")
            band = sum(len(body) >= b for b in (32, 64, 128))
            found.append((k, m.start(), m.end(), band, math.floor(-math.log10(p_of(body)) * 50)))
    cut = {}
    for band in range(4):
        steps = sorted((f[4] for f in found if f[3] == band), reverse=True)
        passed = [s for s in steps if 10 ** (-s / 50) <= 0.05 * sum(o >= s for o in steps) / len(steps)]
        cut[band] = min(passed, default=10**9)
    out = {k: [] for k in range(len(texts))}
    for k, a, b, band, step in found:
        if step < cut[band] and not any(x[0] <= a and b <= x[2] for x in brute(texts[k])):
            out[k].append(f"random:{a}:{b}")
    return out


def test_battery_matches_plain_python(spark):
    rng = random.Random(4)
    pools = [secrets.HEX, secrets.BASE32, secrets.BASE64[26:62], secrets.BASE62, secrets.BASE64, secrets.URL64]
    names = ["internationalization_of_names", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabc", "https-www-example-com-some-page", "01234567890123456789012345", "ThisIsACamelCaseIdentifierName", "x/y/z/path/to/some/file/in/a/folder"]
    texts = []
    for _ in range(150):
        parts = [rng.choice([rng.choice(names) + str(rng.randint(0, 99)), "".join(rng.choices(rng.choice(pools), k=rng.choice([20, 31, 32, 40, 64, 90, 130]))) + "=" * rng.randint(0, 2), "plain words é"]) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(parts))
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("random")] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want = plain_random(texts)
    assert got == want and sum(map(len, want.values())) > 100

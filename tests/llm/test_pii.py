import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    keep = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 16 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0,
        "phone": lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m[0])] for k, p in BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ (2)4%Z", max_size=40) | st.lists(st.sampled_from(["4111 1111 1111 1111", "a@b.c", "@", "1.2.3.4", "256.", "+1 (555) 123-4567", " ", ".", "9", "@x.y@z.w"]), max_size=8).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.detect(text) == brute(text)


def added(text):
    return {k: [text[a:b] for a, b in v] for k, v in pii.hidden(text, pii.detect(text)).items() if v}


def test_disguises_are_found_at_their_source_offsets():
    assert added("write to bob [at] mail (dot) example (dot) com now")["email"] == ["bob [at] mail (dot) example (dot) com"]
    assert added("ask jane.roe at mail dot example dot org today")["email"] == ["jane.roe at mail dot example dot org"]
    assert added("ｂｏｂ@ｅxample．com")["email"] == ["ｂｏｂ@ｅxample．com"]
    assert added("bоb@exаmple.com")["email"] == ["bоb@exаmple.com"]  # two Cyrillic letters
    assert added("bob@exam​ple.com here")["email"] == ["bob@exam​ple.com"]
    assert added("call plus one five five five one two three four five six seven ok")["phone"] == ["plus one five five five one two three four five six seven"]
    assert added("card four one one one one one one one one one one one one one one one.")["card"]
    assert added("write jane.roe at mail.example.com or x42 at example.org")["email"] == ["jane.roe at mail.example.com", "x42 at example.org"]
    assert added("bob[@]mail[.]example[.]com, bob (arroba) mail (punto) es")["email"] == ["bob[@]mail[.]example[.]com", "bob (arroba) mail (punto) es"]
    assert added("host 10 dot 0 dot 0 dot 7 and 192[.]168[.]1[.]9")["ip"] == ["10 dot 0 dot 0 dot 7", "192[.]168[.]1[.]9"]
    assert added("host one nine two dot one six eight dot one dot one up")["ip"]


def test_clean_text_is_left_alone():
    for text in ("Meet me at noon, dot your i and look at example.com", "one two three", "", "é ß ñ Überall naïve", "He was at home."):
        assert added(text) == {}


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "zero " * 60_000, " dot " * 60_000):
        pii.hidden(text, pii.detect(text))


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (4, "a@b.co", "x"), (4, "a@b.co", "x")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r.doc_id or -1, r.n_email, r.spans) for r in got) == [(-1, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (4, 1, "email:0:6"), (4, 1, "email:0:6")]
    assert {r.base_sha256 for r in got if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masking_keeps_columns(spark):
    df = spark.createDataFrame([(1, "hi a@b.co and +1 555 123 4567!", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(pii.mask_pii(df).collect()) == [(1, "hi <email> and <phone>!", "en"), (2, None, None)]


def test_long_runs_take_linear_time():
    for text in (" " * 1_000_000 + "x bob (at) mail", "( " * 300_000 + "at", "bob (at) mail (dot) com " * 20_000, "a at " * 100_000, "one " + " " * 500_000 + "two", "+1" + "-" * 500_000):
        began = time.process_time()
        pii.hidden(text, pii.detect(text))
        assert time.process_time() - began < 8
    assert pii.mask_text("write to bob  (at)  mail  (dot)  com") == "write to <email>"

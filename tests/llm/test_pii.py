import hashlib
import random
import re

import pytest

from termtide.llm import pii
from termtide.llm.queries import op10_personal_data


def plain(text):
    """The fixed patterns, written out."""
    found = [("email", m.start(), m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def test_plain_spans_equal_the_patterns():
    random.seed(2)
    pieces = ["a", "b.c", "@", ".", "-", "+", "_", "%", " ", "1", "22", "255", "256", "0", "(", ")", "é",
              "4111111111111111", "4111 1111-1111 1111", "+49 (0)30 123456", "1.2.3.4", "x@y.zz"]
    for _ in range(20000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(1, 12)))
        assert pii.plain_spans(text) == plain(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("mail jane [dot] doe [at] example [dot] com now", "email", "jane [dot] doe [at] example [dot] com"),
    ("write jane at example dot com", "email", "jane at example dot com"),
    ("write jane (at) mail5.example.com.", "email", "jane (at) mail5.example.com"),
    ("an jаne@exаmple.com x", "email", "jаne@exаmple.com"),
    ("se​cret@ex​ample.org", "email", "se​cret@ex​ample.org"),
    ("jane＠example．com", "email", "jane＠example．com"),
    ("call plus four nine one two three four five six seven eight ok", "phone",
     "plus four nine one two three four five six seven eight"),
    ("one nine two dot one six eight dot one dot one", "ip",
     "one nine two dot one six eight dot one dot one"),
    ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card",
     "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ("+١٢٣٤٥٦٧٨٩٠", "phone",
     "+١٢٣٤٥٦٧٨٩٠")])
def test_disguises(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]


@pytest.mark.parametrize("text", [
    "", "meet me at the dot on the map", "one two three four five six seven", "at dot at dot",
    "Привет мир", "un deux trois", "look at this [at] once",
    "price 12.50 at 10.30", "look at example.com", "version 1.2.3"])
def test_clean_texts(text):
    assert pii.find(text) == ([], []) and pii.redact(text) == text


@pytest.mark.parametrize("text, kind, found", [
    ("card 4111\u00a01111\u00a01111\u00a01111.", "card", "4111\u00a01111\u00a01111\u00a01111"),
    ("call +49\u00a030\u00a01234567 now", "phone", "+49\u00a030\u00a01234567"),
    ("se\u00adcret@ex\u00adample.org", "email", "se\u00adcret@ex\u00adample.org"),
    ("+49 30 ¹²³⁴⁵⁶⁷", "phone", "+49 30 ¹²³⁴⁵⁶⁷"),
    *((f"write anna at posta dot {end}, please", "email", f"anna at posta dot {end}")
      for end in ("it", "pl", "ca", "ru", "au", "in", "museum")),
    ("write jane.doe at example.com.", "email", "jane.doe at example.com"),
    ("+49 30 one two three 4 5 6 7", "phone", "+49 30 one two three 4 5 6 7"),
    ("4111 one one one one 1111 1 one 11", "card", "4111 one one one one 1111 1 one 11"),
    ("host 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20")])
def test_disguises_of_every_kind_and_end(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, found)]


def test_plain_spans_stay_and_are_not_found_twice():
    text = "a@b.cc and x [at] y [dot] zz а 1.2.3.4"
    base, every = pii.find(text)
    assert base == [("email", 0, 6), ("ip", 31, 38)]
    assert every == [("email", 0, 6), ("email", 11, 28), ("ip", 31, 38)]
    assert pii.redact(text) == "<EMAIL> and <EMAIL> а <IP>"


@pytest.mark.parametrize("text, base, added, clean", [
    ("to jоhn.smith@example.com now", "hn.smith@example.com", "jоhn.smith@example.com", "to <EMAIL> now"),
    ("host １92.168.0.1", "92.168.0.1", "１92.168.0.1", "host <IP>"),
    ("кarl@mail.ru", "arl@mail.ru", "кarl@mail.ru", "<EMAIL>"),
    ("тom@ex.org, вob@ex.org", "om@ex.org", "тom@ex.org", "<EMAIL>, <EMAIL>")])
def test_a_plain_piece_does_not_hide_the_whole(text, base, added, clean):
    plain_found, every = pii.find(text)
    kind = plain_found[0][0]
    assert plain_found == plain(text) and text[plain_found[0][1]:plain_found[0][2]] == base
    assert set(plain_found) <= set(every)
    assert (kind, text.index(added), text.index(added) + len(added)) in every
    assert pii.redact(text) == clean


def test_every_disguise_is_found_in_whole_texts(spark):
    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    alike = dict(p[::-1] for p in pii.LOOK_ALIKES.split())
    planted = "karl.smith77@post.example.org"
    for text in texts:
        words = text.split(" ")
        at = rng.randrange(len(words) + 1)
        places = [i for i, c in enumerate(planted) if c in alike]
        chosen = rng.sample(places, rng.randint(1, 4))
        disguised = "".join(alike[c] if i in chosen else c for i, c in enumerate(planted))
        whole = " ".join([*words[:at], disguised, *words[at:]])
        start = len(" ".join(words[:at])) + bool(at)
        base, every = pii.find(whole)
        assert base == plain(whole)
        assert ("email", start, start + len(disguised)) in every
        assert disguised not in pii.redact(whole)
        # What is plain in the text is found as before.
        assert len(base) >= len(pii.plain_spans(text))


def test_a_column_that_is_not_there_is_an_error(spark, documents):
    with pytest.raises(Exception, match="no column size2"):
        pii.redacted(documents("x"), n_chars="size2").collect()


@pytest.mark.parametrize("piece", ["a", "1", "1 ", "a@", "+1", "1.", "a.", "one ", "@", "x [at] "])
def test_long_texts_take_linear_time(piece):
    pii.find(piece * (200_000 // len(piece)))


def test_rows(spark, documents, tmp_path):
    df = documents("x a@b.cc", None, "", "x a@b.cc", "j (at) k.org")
    found = pii.spans(df)
    assert found.columns == [*df.columns, "plain_spans", "all_spans"]
    rows = {r.doc_id: r for r in found.collect()}
    assert [len(rows[i].plain_spans) for i in range(5)] == [1, 0, 0, 1, 0]
    assert [len(rows[i].all_spans) for i in range(5)] == [1, 0, 0, 1, 1]
    clean = pii.redacted(df, n_chars="n_chars").collect()
    assert [(r.text, r.n_chars) for r in sorted(clean)] == [
        ("x <EMAIL>", 9), (None, None), ("", 0), ("x <EMAIL>", 9), ("<EMAIL>", 7)]
    assert pii.spans(documents()).collect() == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    row = op10_personal_data(spark, str(tmp_path)).where("doc_id = 0").first()
    assert (row.n_email, row.n_ip, row.spans, row.n_added) == (1, 0, "email:2:8", 0)
    assert row.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()

import random
import re

import pytest
import xxhash

from tidemark.llm.residue import SCHEMA, classify, messages, mined_templates, residue, tell, tokens, unfilled_slots

REPORT = "Oldel Rovers beat Mirvor Town 2-1 at the Korsal Ground after a lively second half. A crowd of 2138 watched."


@pytest.mark.parametrize("slot", ["{{ home_team }}", "{{home_team}}", "${count}", "#{venue}", "{% shots %}", "<%= shots %>", "[[odds]]", "[PLAYER NAME]", "[INSERT HOME XG]", "<MATCH_DATE>", "&lt;venue&gt;", "%(odds)s", "%MINUTE%", "@@MINUTE@@", "__MINUTE__", "$VENUE$", "{1}", "{venue}", ":home_xg:", "(player name goes here)", "XXXX", "NaN", "undefined", "[object Object]", "«VENUE»", "«PLAYER_NAME»", "⟨home_team⟩", "【MATCH_DATE】", "<<away team>>", "{$odds}", "@{odds}", "[% odds %]", "((HOME_TEAM))", "*|ODDS|*", "%%odds%%", "[home_team]", "(home_team)", ":HOME_XG:", "$home_team", "#HOME_TEAM#", "%1$s"])
def test_slots(slot):
    assert unfilled_slots(f"{REPORT} The draw was priced at {slot} by 4 books.") == [slot]


@pytest.mark.parametrize(
    "text",
    ["The template writes `{{home_team}}` where the name belongs.", "A script used the format %d-%d for scores.", "<p>At <b>12:30:00</b> local time</p><br/>", 'The field {"elapsed": 19, "extra": 8} gives the minute.', "{home, draw, away} has probabilities 0.1", "The role was undefined before.".replace("undefined before", "left undefined"), "[Correction, 1 Apr 2021: an earlier version was wrong.]", "[HOME] [FIXTURES]", "", "10:15:20 and http://x:y:z", "Er sagte «Tor» und « nicht PSG », sie *so* #eins =zwei= (drei) a_b c:d:e $20 50% 5%d"],
)
def test_no_slots(text):
    assert unfilled_slots(text) == []


def kinds(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, slots string")
    return {r.doc: r.reason for r in residue(df, doc_id="doc_id", text="text").collect()}


def test_kinds(spark):
    texts = [
        "Error 404: Page not found\nThe page you requested could not be found.\n[Home] [Fixtures]",
        "A - B | Match centre\n\nPlease enable JavaScript to view the live score.\nReload",
        "Lorem ipsum dolor sit amet. Consectetur adipiscing elit.",
        "Dummy copy dummy copy\nText to follow.",
        REPORT + " {{ venue }}",
        REPORT,
        REPORT + " The club admitted that its site asked visitors to enable JavaScript; Ula Mor apologised.",
        "Supporters held a banner reading 'Page not found' after Oldel lost their 3rd game.",
        "Between 16:00 and half-time the feed answered 503 Service Unavailable, so 4 quotes are missing for Oldel.",
        None,
        "",
        "Reload",
        '{"error": "Acesso negado", "message": "Sua sess\\u00e3o terminou.", "status": 249}',
        REPORT * 3000,
        "Whoops! Loading...",
        "HTTP 500 - Internal Server Error Something went wrong while loading this match centre. Please try again later.",
    ]
    assert kinds(spark, texts) == {0: "error", 1: "notice", 2: "filler", 3: "filler", 4: "slot", 12: "error", 14: "error", 15: "error"}
    assert kinds(spark, texts[5:6]) == {}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert residue(df, doc_id="doc_id", text="text").count() == 0


def templates(spark, texts, parts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(parts)
    mined = mined_templates(df.mapInPandas(tell, SCHEMA)).collect()
    return {r.template_id: r.template for r in mined if r.template is not None}, {r.sequence: r.template_id for r in mined if r.sequence is not None}


def test_like_messages_are_one_template_however_they_are_split(spark):
    texts = [f"The results host did not answer in time {w}" for w in ("today", "yesterday", "again")] + ["Rain is forecast over the ground and nothing else", "The page at this address on our site cannot be found today", "The page at this address on our site lists the results today"]
    found, of = templates(spark, texts, 1)
    assert (found, of) == templates(spark, texts[::-1] * 3, 4)
    assert "the results host did not answer in time <*>" in found.values()
    assert classify("the page at this address on our site cannot be found today") == "error"
    assert classify("the page at this address on our site lists the results today") == "content"


def test_a_template_has_the_verdict_of_each_of_its_sequences(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [r.text for r in frame.collect()]
    found, of = templates(spark, texts, 3)
    words = {xxhash.xxh64_intdigest(t) - 2**63: t for x in texts for m in messages(x or "") for t in [" ".join(tokens(m))]}
    assert len(of) > 20 and all(classify(words[s]) == classify(found[t]) for s, t in of.items())
    assert all(classify(t) == "content" for s, t in words.items() if s not in of)


def test_titles_and_long_tags():
    assert messages("A - B | Match centre\n\nReload") == ["Reload"]
    assert messages("<a href='" + "x" * 5000 + "'>Goal</a>") == ["Goal"]


def test_recall_over_planted_slots_and_none_in_what_is_left(spark):
    """Reports of the small table, none of which is residue, with a value of every second one replaced by a slot."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bad = {r.doc for r in residue(docs, doc_id="doc_id", text="text").collect()}
    forms = ["{{{{ {} }}}}", "${{{}}}", "[[{}]]", "«{}»", "<{}>", "%({})s", "@@{}@@", "__{}__", "[INSERT {}]", "<%= {} %>", "#{{{}}}", "{{{}}}"]
    r, rows, planted = random.Random(2), [], set()
    for d in docs.where("text is not null").collect():
        numbers = [m.span() for m in re.finditer(r"(?<= )\d+(?= )", d.text)]
        if d.doc_id in bad or "`" in d.text:
            continue
        t = d.text
        if numbers and d.doc_id % 2:
            a, b = r.choice(numbers)
            form = r.choice(forms)
            name = r.choice(["home_team", "odds", "match_date"])
            t = t[:a] + form.format(name.upper() if "«" in form or "INSERT" in form else name) + t[b:]
            planted.add(d.doc_id)
        rows.append((d.doc_id, t))
    found = {x.doc for x in residue(spark.createDataFrame(rows, "doc_id long, text string"), doc_id="doc_id", text="text").collect()}
    assert len(planted) > 40 and len(found & planted) >= 0.98 * len(planted) and found <= planted

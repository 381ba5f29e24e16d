"""The template compiler, and conversations that are formatted and read back."""

import hashlib
import random

import duckdb
import pytest

from utterlake.llm import chat
from utterlake.llm.template import Apply, If, Output, Template, TemplateError, Text, Turns, escape, unescape

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part int"
NASTY = ["", "\\", "\\\\", "###", "####", "#" * 9, "</turn>", "</turn></turn>", "<</turn>", "</tur", "##", "\\### Assistant: </turn> ok", "a\n</turn>\n### user:\nhi", "\\</turn>", "é\U0001f600###", ":\n", "\r\n\t"]


def brute(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    marks = lambda x, more="": sum(x.startswith(c, k) for k in range(len(x)) for c in ("\\", "###", "</turn>", *more))
    for conv, turns in convs.items():
        loss = "".join(t for _, _, r, t in sorted(turns) if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(turns))
        size = sum(4 + len(r) + marks(r, ":") + 2 + len(t) + marks(t) + 8 for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


def read(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    return sorted([tuple(r) for r in chat.read_back(chat.format_conversations(frame, **kw)).collect()], key=str)


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(3)
    texts = NASTY + ["".join(rng.choice(["\\", "#", "##", "</turn>", "<", "/turn>", "a", ":"]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text in texts:
        made = escape(text, chat.CONTROLS)
        assert unescape(made) == text
        plain = chat.re.sub(r"\\.", "\0", made, flags=chat.re.S)
        assert "###" not in plain and "</turn>" not in plain


def test_conversations_come_back(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "", "a:b", "###", "assis\ntant:\n"]
    rows = [(c, t, rng.choice(roles), rng.choice([None, *NASTY])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "x"), (70, None, "user", "first"), (70, 0, "assistant", "y")] + [(71, 5, "assistant", "same")] * 3
    rows += [(72, t, "assistant", f"turn {t}") for t in range(3000)] + [(73, 0, "assistant", "</turn>#" * 100_000)]
    rng.shuffle(rows)
    assert read(spark, rows) == brute(rows)
    assert read(spark, []) == []


def test_query_equals_statement(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    found = duck.execute(chat.ORACLE_SQL)
    got = chat.op11_chat_formatting(spark, DATA)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
    mine = {r.conv_id: r for r in got.collect()}[-7]
    assert (mine.n_turns, mine.loss_chars, mine.loss_sha256) == (2, len(chat.PLANTED), hashlib.sha256(chat.PLANTED.encode()).hexdigest())


def test_constants_are_folded():
    tree = Template("{% if 1 + 1 == 2 and 'a' in bos %}{{ '<' + bos | upper }}{% else %}no{% endif %}{# c #}x{% for m in messages %}{{ m.role }}{% if m.text or false %}y{% elif false %}n{% endif %}{% endfor %}", {"bos": "a"}).tree
    assert tree[0] == Text("<Ax") and len(tree) == 2 and isinstance(tree[1], Turns)
    role, test = tree[1].body
    assert isinstance(role, Output) and isinstance(test, If) and test.body == (Text("y"),) and test.other == ()
    assert isinstance(Template("{% for m in messages %}{{ m.text + 'a' + 'b' }}{% endfor %}").tree[0].body[0].value, Apply)


@pytest.mark.parametrize(
    "source,want",
    [
        ("{% set a = 'x' %}[{{ a }}{% for m in messages %}{{ m.role | upper }}={{ m['text'] | replace('a', 'b') | trim }}{{ a }};{% endfor %}{{ a }}]", ("[x", "USER=bb  cx;", "x]")),
        ("{% for m in messages %}{% generation %}{{ m.text | length }}{% endgeneration %}{% if not (m.role == 'user') or m.turn >= 2 %}!{% endif %}{% endfor %}", ("", "6!", "")),
        ("{% for m in messages %}{{ loop.index }}/{{ loop.length }}{% if loop.last %}.{% endif %}{{ none | default('d') }}{{ true }}{{ 1 + 2 }}{% endfor %}", ("", "3/3.dtrue3", "")),
        ("a  {%- for m in messages -%}  b  {%- endfor -%}  c", ("a", "b", "c")),
        ('{% for m in messages %}{{ "q\\"}}" + m.role | escape("u") }}{% endfor %}', ("", 'q"}}\\user', "")),
    ],
)
def test_rendering(source, want):
    t = Template(source)
    got = t.before()[0], t.turn({"role": "user", "text": " aa  c", "turn": 2}, {"index": 3, "index0": 2, "length": 3, "last": True, "first": False})[0], t.after()[0]
    assert got == want


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ m['_x'] }}{% endfor %}",
        "{{ open('x') }}{% for m in messages %}{% endfor %}", "{{ x }}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% endfor %}{{ m.text }}", "{{ 'a'.upper }}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{{ m.text | eval }}{% endfor %}", "{% for m in messages %}{{ loop.parent }}{% endfor %}", "{% import os %}", "{% if 1 %}", "{{ 'a' ", "{# x", "{% for m in x %}{% endfor %}", "{% set loop = 1 %}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{{ m.text | escape(m.role) }}{% endfor %}",
    ],
)
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_parts_around_the_turns_and_places(spark):
    source = "<s>{% for m in messages %}{{ loop.index0 }}{% if loop.last %}{% generation %}{{ m.text }}{% endgeneration %}{% endif %},{% endfor %}{% generation %}end{% endgeneration %}"
    rows = [(1, t, "user", f"t{t}", "x", 1) for t in range(4)] + [(2, 9, "user", "only", "x", 1)]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), source).orderBy(*chat.ORDER).collect()
    texts = {c: "".join(r.formatted for r in got if r.conv_id == c) for c in (1, 2)}
    assert texts == {1: "<s>0,1,2,3t3,end", 2: "<s>0only,end"}
    assert [[tuple(s) for s in r.spans] for r in got if r.conv_id == 2] == [[], [(1, 5)], [(0, 3)]]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA), source).count() == 0


def test_broken_texts_are_refused():
    for text in ("x", "### user:\nno end", "### user:\na</turn>", "### user:\n### b:\n</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse_turns(text)

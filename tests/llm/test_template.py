import pytest

from plantwatch.llm.template import FILTERS, Template, TemplateError, fold, parse

TALK = [{"role": "system", "content": " be brief "}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]


def rendered(source, messages=TALK, **constants):
    return Template(source, constants).render(messages)


@pytest.mark.parametrize("source, text", [
    ("a{# no #}b", "ab"),
    ("{{ 'x' + \"y\" ~ 3 }}", "xy3"),
    ("{{ 'a\\n\\'b' }}", "a\n'b"),
    ("a {{- 'b' -}} c", "abc"),
    ("{% if 1 < 2 and not false %}y{% else %}n{% endif %}", "y"),
    ("{% if 'a' not in 'bcd' %}1{% endif %}{% if 'b' in ['b'] %}2{% endif %}", "12"),
    ("{% if 1 == 2 %}a{% elif 2 >= 2 %}b{% else %}c{% endif %}", "b"),
    ("{% set x = 'q' %}{{ x | upper }}{{ y | default('z') }}{{ y }}", "Qz"),
    ("{% if y is defined %}a{% endif %}{% if y is not defined %}b{% endif %}{% if none is none %}c{% endif %}", "bc"),
    ("{% for a in ['x', 'y'] %}{{ loop.index }}{{ a }}{% if not loop.last %},{% endif %}{% endfor %}", "1x,2y"),
    ("{{ ['a', 'b'] | join('-') }}{{ 'abc' | length }}{{ 'a.b' | replace('.', '') }}", "a-b3ab"),
    ("{% for m in messages %}{{ m.role[0] }}{{ m['content'] | trim }}/{% endfor %}", "sbe brief/uhi/ayo/"),
    ("{% for m in messages %}{% if loop.previtem is defined %}{{ loop.previtem.role }}>{% endif %}{% endfor %}", "system>user>"),
    ("{% for m in messages %}{% if loop.first %}{{ loop.nextitem.content }}{% endif %}{% endfor %}", "hi"),
    ("{% for m in messages %}{% set seen = m.role %}{% endfor %}{{ seen | default('none') }}", "none"),
    ("{{ m.role.upper }}{{ bos.__class__ }}", ""),
])
def test_language(source, text):
    assert rendered(source)[0] == text


def test_no_messages_and_constants():
    assert rendered("{{ bos }}{% for m in messages %}x{% endfor %}{% if more %}!{% endif %}", [], bos="<s>", more=True) == ("<s>!", [])


@pytest.mark.parametrize("source", [
    "{{ 'a' ", "{% if x %}", "{% endif %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ messages }}",
    "{% if x %}{% for m in messages %}{% endfor %}{% endif %}", "{% generation %}{% endgeneration %}", "{{ f('x') }}", "{{ 'x' | unknown }}", "{{ 1 + 'x' }}",
    "{{ 'x' | replace('y') }}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{% import os %}", "{{ 1 2 }}", "{{ a ? }}", "{% for a in 'abc' %}{% endfor %}",
    "{% if x %}" * 60 + "{% endif %}" * 60, "{% for if in x %}{% endfor %}", "{{ ['a'] }}", "{{ 'a' < 1 }}", "{{ loop.index0 + messages }}",
    "".join("{% for a in ['x'] %}" for _ in range(5)) + "{% endfor %}" * 5])
def test_refused(source):
    with pytest.raises(TemplateError):
        rendered(source)


def test_constants_are_folded():
    source = "a{{ bos }}{% if tools and deep.x %}T{% elif fine %}F{% else %}N{% endif %}{{ ('p' + 'q') | upper }}{% for m in messages %}{{ m.role == 'a' or true }}{% endfor %}"
    tree = fold(parse(source), {"bos": "<s>", "tools": False, "fine": True}, FILTERS)
    assert tree[0] == ("text", "a<s>FPQ") and len(tree) == 2 and tree[1][0] == "for"
    tree = fold(parse("{% if x or false %}{{ 'a' }}{{ 'b' }}{% endif %}"), {}, FILTERS)
    assert tree == [("if", [(("or", ("name", "x"), ("const", False)), [("text", "ab")])], [])]
    # a name that the template sets is no constant
    assert Template("{% set bos = 'b' %}{{ bos }}", {"bos": "a"}).render([])[0] == "b"


def test_spans_and_pieces():
    source = "{% for m in messages %}[{{ m.role }}]{% if m.role == 'assistant' %}{% generation %}{{ m.content }}{% endgeneration %}{% endif %};{% endfor %}."
    made = Template(source)
    text, spans = made.render(TALK)
    assert text == "[system];[user];[assistant]yo;." and [text[a:b] for a, b in spans] == ["yo"]
    pieces = list(made.pieces(TALK * 3, size=1))
    assert len(pieces) == 9 and "".join(p for p, _ in pieces) == made.render(TALK * 3)[0]
    assert [p[a:b] for p, inner in pieces for a, b in inner] == ["yo"] * 3


def test_messages_stream():
    drawn = []

    def messages():
        for k in range(5):
            drawn.append(k)
            yield {"role": "user", "content": str(k)}
    pieces = Template("{% for m in messages %}{{ m.content }}{% endfor %}").pieces(messages(), size=1)
    assert next(pieces)[0] == "0" and len(drawn) <= 3

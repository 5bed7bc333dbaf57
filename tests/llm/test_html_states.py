"""Tags, comments and lists as HTML's states have them."""

import time

import pytest

from screenlab.llm.html_text import render

CASES = {
    "<p title=don't>visible <b>can't</b> stop</p>": "visible can't stop",
    '<div class="x"">hello "world" bye</div>': 'hello "world" bye',
    "<a href='x'y'>one</a> it's two": "one it's two",
    '<p "a" b\'>one</p>two"': 'one\n\ntwo"',
    "<p a = >x</p>": "x",
    "<p a=b/c>x</p>y": "x\n\ny",
    '<p a="1 > 2">x</p>': "x",
    "<p a=\"it's\" b='say \"x\"'>y</p>": "y",
    "a <b c": "a",
    'a <b c="d>e</b> f': "a",
    "1 < 2 and 3 <4 <": "1 < 2 and 3 <4 <",
    "<!-->shown": "shown",
    "<!--->shown": "shown",
    "<!-- x --!>shown": "shown",
    "<!-- a > b -->shown<!-- rest": "shown",
    "<!-- a -- b -->c": "c",
    "a</>b</3 c>d<?php x ?>e<!doctype y>f": "abdef",
    "<ruby>字<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>": "字ji",
    "<dialog>no</dialog>yes<dialog open>this</dialog>": "yes\nthis",
    "<ol><li>a<li value=5>b<li>c</ol>": "1. a\n5. b\n6. c",
    "<ol start=3><li>a<li>b</ol>": "3. a\n4. b",
    "<ol start=-1><li>a<li>b<li>c</ol>": "-1. a\n0. b\n1. c",
    "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
    "<ol reversed start=9><li>a<li>b</ol>": "9. a\n8. b",
    "<ol reversed><li>a<ol reversed><li>x<li>y</ol><li value=7>b<li>c</ol>": "3. a\n  2. x\n  1. y\n7. b\n6. c",
    "<ol reversed><li></li><li>b</ol>": "1. b",
    "<table><tr><td><ol reversed><li>a<li>b</ol><td>c</table>": "2. a  c\n1. b",
    "a<plaintext>b <i>c</i></plaintext>": "a\nb <i>c</i></plaintext>",
    "<p hidden='until-found'>a</p><p title='hidden'>b</p><p data-x=hidden>c</p>": "b\n\nc",
}


@pytest.mark.parametrize("source", CASES)
def test_states(source):
    assert render(source) == CASES[source]


@pytest.mark.parametrize("source", ["<a " + "b" * 50 + " " * 50, "<p a" + " " * 100 + "b", "<a b='", "<!-- -", "<ol reversed><li>x", "</ x", "<a =" * 3, '<a "'])
def test_work_follows_the_page(source):
    def took(n):
        began = time.process_time()
        render(source * n)
        return time.process_time() - began

    took(50)
    assert took(40_000) < 40 * max(took(4_000), 0.02)

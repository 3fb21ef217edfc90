"""The page's own markup over the block tree: whole pages, tags, broken fences, destinations, bold marks."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliate.functions import blocks, destinations, flanking, markup

#: A page, and what it becomes; None: it stays.
CASES = [
    ('<table header-row="true"><tr><td>Fruit</td><td>Count</td></tr><tr><td>Plum</td><td>90</td></tr></table>', "| Fruit | Count |\n| ----- | ----- |\n| Plum  | 90    |"),
    ("<table><tr><td>Cherry</td><td>90</td></tr><tr><td>Fig</td><td></td></tr></table>", "|        |    |\n| ------ | -- |\n| Cherry | 90 |\n| Fig    |    |"),
    ('<table header-row="true"><colgroup><col><col width="6"></colgroup><tr><td>Fruit</td><td>a|b</td></tr></table>', "| Fruit | a\\|b |\n| ----- | ---- |"),
    ('<callout>Body</callout>', '> [!note]\n> Body'),
    ('<table header-row="true"><tr><td>A</td><td>B</td></tr></table>MORE', None),
    ('<table header-row="true"><tr><td>A</td>STRAY<td>B</td></tr></table>', None),
    ('<table_of_contents/>', ''),
    ('Start\n\n<table_of_contents/>\n\nBetween\n\n<table_of_contents color="gray"/>\n\nEnd', 'Start\n\nBetween\n\nEnd'),
    ('`<table_of_contents/>`\n\n```\n<table_of_contents/>\n```\n', None),
    ('Start <table_of_contents/> after', 'Start  after'),
    ('<table_of_contents/>\nWeighty', None),
    ('<synced_block url="u">Body</synced_block>', 'Body'),
    ('<synced_block_reference url="u">\nBody\n</synced_block_reference>\nRest', 'Body\n\nRest'),
    ('Start\n<callout>Hint</callout>\nEnd', 'Start\n\n> [!note]\n> Hint\n\nEnd'),
    ('Start <span color="teal">**C**</span> and <span underline="true">c</span>.\n<synced_block url="u">\n<callout icon="x">\n**P**\nQ\n</callout>\n</synced_block>\nEnd', 'Start ==**C**== and <u>c</u>.\n\n> [!note]\n> **P**\n> Q\n\nEnd'),
    ('Start <callout>One</callout> Between <callout>Two</callout> End', 'Start\n\n> [!note]\n> One\n\nBetween\n\n> [!note]\n> Two\n\nEnd'),
    ('Start <synced_block url="outer">Around <synced_block url="inner">Within</synced_block> Last</synced_block> End', 'Start\n\nAround\n\nWithin\n\nLast\n\nEnd'),
    ('Start <callout>Hint <synced_block url="x"></callout></synced_block> End', None),
    ('Start <callout>Hint End', None),
    ('Start Hint</callout> End', None),
    ('Start <callout>Around <callout>Within</callout></callout> End', None),
    ('Start <calloutlike>Hint</calloutlike> End', None),
    ('<synced_block url="e"></synced_block>', ''),
    ('<synced_block url="e">\n<callout icon="x">Hint</callout>\n</synced_block>', '> [!note]\n> Hint'),
    ('<synced_block url="o">\n<synced_block url="i">\nWithin\n</synced_block>\nRest', None),
    ('<synced_block url="outer">\n<div data-value="</synced_block>">Field</div>\nBody after\n</synced_block>\nRest', '<div data-value="</synced_block>">Field</div>\nBody after\n\nRest'),
    ('<synced_block url="outer">\n<!-- </synced_block> -->\nBody\n</synced_block>\nRest', '<!-- </synced_block> -->\nBody\n\nRest'),
    ('<columns>\n<column>\nOne column\n</column>\n<column>\nTwo column\n</column>\n</columns>', 'One column\n\nTwo column'),
    ('<callout>See <synced_block url="e">Body</synced_block></callout>', '> [!note]\n> See\n>\n> Body'),
    ('<span color="teal" underline="true">text</span>', '<u>==text==</u>'),
    ('<span discussion-urls="a,b">text</span>', 'text'),
    ('<span class="foo">text</span>', None),
    ('before <span color="red">text after', None),
    ('<span color="red"></span>', ''),
    ('<span color="red">\nhello\n\nworld\n\n</span>', None),
    ('A <span color="red">B</span> C <span underline="true">D</span> E', 'A ==B== C <u>D</u> E'),
    ('1. text\n   ```python\nprint(1)\nprint(2)\n   ```\n', '1. text\n   ```python\n   print(1)\n   print(2)\n   ```\n'),
    ('1. text\n\n   ```js\n   ```\n', None),
    ('1. text\n\n   ```js\n   ```\n\nSome paragraph.\n\n```\nplain code\n```\n', None),
    ('1. text\n   ```js\nline1\nline2\n   ```\n\nEnd list paragraph.\n', '1. text\n   ```js\n   line1\n   line2\n   ```\n\nEnd list paragraph.\n'),
    ('1. text\n   ```js\nline1\n   ```\n\n2. more\n   ```ts\nline2\n   ```\n', None),
    ('1. text\n   ```js\nline1\n   ```\n\n2. more\n   ~~~ts\nline2\n   ~~~\n', '1. text\n   ```js\n   line1\n   ```\n\n2. more\n   ~~~ts\n   line2\n   ~~~\n'),
    ('1. text\n   ```js\nline1\n   ```\n\n2. more\n   ```ts\nline2\n\nEnd.\n', '1. text\n   ```js\n   line1\n   ```\n\n2. more\n   ```ts\nline2\n\nEnd.\n'),
    ('1. text\n   ```js\nline1\n\n    apart\n    code\n', None),
    ('1. text\n   ```js\nline1\n\n```\n**not bold** # not heading\n```\n', None),
    ('1. text\n   ```js\nline1\n\n    ```\n    hidden\n', None),
    ('1. text\n\t```js\nprint(1)\n```\n', '1. text\n   ```js\n   print(1)\n   ```\n'),
    ('1. text\n   ```js\nline1\n\n\t```\n', None),
    ('t)text\n<callout icon="x" color="blue">\npart 1\npart 2\n\n</callout>\nnext\n', 't)text\n\n> [!note]\n> part 1\n> part 2\n\nnext\n'),
    ('t\n<callout icon="x">\n**bold**\n\n</callout>\nn\n', None),
    ('t\n<callout icon="x">\nbody\n\nplain words between\n\n</callout>\n', None),
    ('t\n<callout icon="x">\nbody\n\n</callout>\n1. text\n   ```python\nprint(1)\n   ```\n', 't\n\n> [!note]\n> body\n\n1. text\n   ```python\n   print(1)\n   ```\n'),
    ('- first thing\n- second thing\n  <callout icon="x">\n  body\n</callout>\nand on\n', '- first thing\n- second thing\n  > [!note]\n  > body\n\nand on\n'),
    ('1. text\n\t1. nested\n2. more\n\t```plain words\nstruct Pond{\n  // **not bold** `inline code` <b>html</b>\n}\n\t```\nbeyond the fence with **bold** and `code`.\n## Next part\n', '1. text\n\t1. nested\n2. more\n   ```plain words\n   struct Pond{\n     // **not bold** `inline code` <b>html</b>\n   }\n   ```\n\nbeyond the fence with **bold** and `code`.\n## Next part\n'),
    ('1. text\n\t````plain words\nline1\n\t```\nafter\n', None),
    ('1. text\n\t```plain words\nline1\n \t```\nafter\n', None),
    ('1. text\n\t```plain words\nline1\n\t```\nmid\n\t```\nafter\n', None),
    ('1. text\n\t```plain words\nline1\n\t``` trailing text\nafter\n', None),
    ('1. text\n\t```plain words\nA{\n}\n    ```\nbeyond the fence text.\n', '1. text\n   ```plain words\n   A{\n   }\n   ```\n\nbeyond the fence text.\n'),
    ('1. text\n\t```plain words\n<synced_block>\n<table_of_contents/>\n\t```\nafter\n', '1. text\n   ```plain words\n   <synced_block>\n   <table_of_contents/>\n   ```\n\nafter\n'),
    ('<callout icon="x">\nbody\n</callout>\n## Next\nmore\n', '> [!note]\n> body\n\n## Next\nmore\n'),
    ('<callout icon="x">\nfirst\n</callout>\n<callout icon="x">\nsecond\n</callout>\n', '> [!note]\n> first\n\n> [!note]\n> second\n'),
    ('1. a\n\t```x\nA\n\t```\nmiddle\n\n1. b\n\t```x\nB\n\t```\nafter\n', '1. a\n   ```x\n   A\n   ```\n\nmiddle\n\n1. b\n   ```x\n   B\n   ```\n\nafter\n'),
    ("- a\n- <callout>Hint</callout>\n- b\n", "- a\n- > [!note]\n  > Hint\n- b\n"),
    ("> Start\n> <callout>Hint</callout>\n> End\n", "> Start\n>\n> > [!note]\n> > Hint\n>\n> End\n"),
    ("1. a\n   - b\n     <callout>\n     c\n</callout>\nd\n", "1. a\n   - b\n     > [!note]\n     > c\n\nd\n"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_enhanced(page, want):
    made = markup.enhanced(page)
    assert made == (page if want is None else want)
    assert markup.enhanced(made) == made


def test_whole_page():
    page = """# Title \U0001f4dd

A paragraph **bold** _slanted_ ~~gone~~.

- Parent
  - Child
- [x] Done

> Quote

---

Inline `<callout>x</callout>` and [a page](https://www.notion.so/page-id).

```typescript
const tag = '<synced_block>';
```

<callout type="warning">
Mind **this**
</callout>

<details><summary>More</summary>
Hidden
</details>

<columns>
<column>
Left
</column>
<column>
Right
</column>
</columns>

<table header-row="true"><tr><td>Fruit</td><td>Count</td></tr><tr><td>Apple</td><td>3</td></tr></table>

<table><tr><th>Raw</th></tr></table>

<synced_block url="u">
Shared <span color="red">text</span>
</synced_block>
1. step
\t```sh
ls <callout>
\t```
"""
    want = page.replace('<callout type="warning">\nMind **this**\n</callout>', "> [!warning]\n> Mind **this**")
    want = want.replace("<columns>\n<column>\nLeft\n</column>\n<column>\nRight\n</column>\n</columns>", "Left\n\nRight")
    want = want.replace('<table header-row="true"><tr><td>Fruit</td><td>Count</td></tr><tr><td>Apple</td><td>3</td></tr></table>', "| Fruit | Count |\n| ----- | ----- |\n| Apple | 3     |")
    want = want.replace('<synced_block url="u">\nShared <span color="red">text</span>\n</synced_block>\n1.', "Shared ==text==\n\n1.").replace("\t```sh\nls <callout>\n\t```", "   ```sh\n   ls <callout>\n   ```")
    assert markup.enhanced(page) == want


@pytest.mark.parametrize("make", [lambda n: "<synced_block>\n" * n + "x\n" + "</synced_block>\n" * n, lambda n: "<synced_block>" * n + "x" + "</synced_block>" * n, lambda n: "<callout>\nb\n</callout>\n" * n, lambda n: "<span color='r'>" * n + "x" + "</span>" * n, lambda n: "a <callout>b</callout> `c` [d](e) " * n])
def test_time_grows_with_the_text(make):
    def seconds(n):
        start = time.process_time()
        markup.enhanced(make(n))
        return time.process_time() - start

    seconds(100)
    assert seconds(10_000) < 20 * max(seconds(1_000), 0.01)


def test_code_survives_a_mended_fence():
    """Every piece of code outside the mended fence is the same after it; a repair that would change one is dropped."""
    page = "`a` **b**\n\n1. x\n\t```py\ny = 1\n\t```\nz `q`\n\n```\ncode\n```\n"
    made = markup.fences(page)
    old, new = ([page[a:b] for a, b in blocks.code_ranges(page)], [made[a:b] for a, b in blocks.code_ranges(made)])
    assert set(old) - {"\t```py"} <= set(new) and "```py\n   y = 1\n   ```" in made
    closes_early = "1. x\n   ```py\n   ```\ny\n```\n"
    assert markup.fences(closes_early) == closes_early


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["1. x\n", "   ```py\n", "\t```py\n", "```\n", "\t```\n", "y\n", "\n", "<callout>\n", "</callout>\n", "- z\n", "> q\n", "`c` <span color='r'>s</span>\n", "    deep\n", "<!-- c -->\n", "| a | b |\n", "| - | - |\n"]), max_size=14))
def test_any_page(lines):
    """No page fails; code that was code keeps its text; rewriting twice is rewriting once for fences."""
    page = "".join(lines)
    tree = blocks.parse(page)
    for block in tree.walk():
        assert 0 <= block.start <= block.end <= len(page)
        assert all(c.start >= block.start and c.end <= block.end for c in block.children)
        for a, b in block.lines:
            assert block.start <= a <= b <= max(block.end, a)
    mended = markup.fences(page)
    assert markup.fences(mended) == mended
    words = lambda t: sorted(t.split())
    assert words(mended) == words(page)
    markup.enhanced(page)


SIGNED = "https://prod-files-secure.s3.us-west-2.amazonaws.com/a/b.png?X-Amz-Signature=1"
CUT = SIGNED.split("?")[0]


@pytest.mark.parametrize(("page", "want", "replaced", "unsafe"), [
    (f"![i]({SIGNED})", f"![i]({CUT})", 1, 0), (f'![i](<{SIGNED}> "t")', f'![i](<{CUT}> "t")', 1, 0), (f"<{SIGNED}>", f"<{CUT}>", 1, 0), (f'<img src="{SIGNED}">', f'<img src="{CUT}">', 1, 0),
    (f"x {SIGNED} y", None, 0, 1), (f"`{SIGNED}` ![a]({SIGNED})", f"`{SIGNED}` ![a]({CUT})", 1, 1), (f"```\n{SIGNED}\n```", None, 0, 1), (f"[![i]({SIGNED})]({SIGNED}#x)", f"[![i]({CUT})]({CUT})", 2, 0),
    (f"<table><tr><td>![i]({SIGNED})</td></tr></table>", f"<table><tr><td>![i]({CUT})</td></tr></table>", 1, 0), (f"<div>\nfoo]({SIGNED}(note))\n</div>", None, 0, 1), (f"[{SIGNED}](x)", None, 0, 1), (f"![i]({SIGNED}&x=%zz)", None, 0, 1),
    (f"![i]({SIGNED.replace('b.png', 'b(1).png')})", f"![i]({CUT.replace('b.png', 'b(1).png')})", 1, 0), (f'<a\n href="{SIGNED}">t</a>', f'<a\n href="{CUT}">t</a>', 1, 0), ("![i](https://www.notion.so/i.png?a=1)", None, 0, 0),
    (f'[t]({SIGNED} "a](b")', f'[t]({CUT} "a](b")', 1, 0), (f"> - ![j]({SIGNED})", f"> - ![j]({CUT})", 1, 0), (f"| a |\n| - |\n| ![j]({SIGNED}) |", f"| a |\n| - |\n| ![j]({CUT}) |", 1, 0),
    ("![i](HTTPS://WWW.NOTION.SO:443/a?expires=1)", "![i](https://www.notion.so/a)", 1, 0), ("![i](https://u@www.notion.so/a?expires=1)", None, 0, 0), ("![i](https://www.notion.so./a?x=1&amp;Signature=2)", "![i](https://www.notion.so./a)", 1, 0),
])
def test_signed_destinations(page, want, replaced, unsafe):
    made = destinations.signed_urls(page)
    assert (made[0], made[1], len(made[2])) == (page if want is None else want, replaced, unsafe)
    assert destinations.signed_urls(made[0])[0] == made[0]


@pytest.mark.parametrize(("page", "want"), [
    ("![a](https://x/1)", "![a](<_assets/1 a.png>)"), ("![a](<https://x/2>)", "![a](<a/b(c)\\&d_e.png>)"), ("![a](https://x/2 'T')", "![a](a/b\\(c\\)\\&d_e.png 'T')"), ("<https://x/2>", "[a/b(c)\\&d\\_e.png](a/b\\(c\\)\\&d_e.png)"),
    ("`![a](https://x/1)`", None), ("[![a](https://x/1)](https://x/2)", "[![a](<_assets/1 a.png>)](a/b\\(c\\)\\&d_e.png)"), ('<img src="https://x/1">', None), ("![a](https://x/3)", None),
])
def test_local_assets(page, want):
    assert destinations.asset_urls(page, {"https://x/1": "_assets/1 a.png", "https://x/2": "a/b(c)&d_e.png"}) == (page if want is None else want)


Z = "\u200b"


@pytest.mark.parametrize(("page", "want"), [
    ("\u524d**\u3001\u5f8c**\u7d9a", f"\u524d**{Z}\u3001\u5f8c**\u7d9a"), ("x**(a)**y", f"x**{Z}(a){Z}**y"), ("text**", None), ("`x**(a)**y`", None), ("\u3053**\u592a**\u3001\u3067", None), ("**a *b* c**", None),
    ("a__(b)__c", None), ("*a**\u3001b**c*", f"*a**{Z}\u3001b**c*"), ("[x**(a)**y](z**(a)**z)", f"[x**{Z}(a){Z}**y](z**(a)**z)"), ("x\\**(a)**y", None),
])
def test_bold_marks(page, want):
    made, own = flanking.bold(page)
    assert made == (page if want is None else want) and flanking.plain(made, own) == page


def test_own_zero_width_spaces():
    for page in (f"a{Z}b x**(a)**y", f"\ue000{Z} x**(a)**y"):
        made, own = flanking.bold(page)
        assert own and own not in page and flanking.plain(made, own) == page and made != page
    full = Z + "".join(chr(0xE000 + k) for k in range(16)) + "x**(a)**y"
    assert flanking.bold(full) == (full, "")


def test_emphasis_pairs():
    assert flanking.pairs("**a *b* c** _d_ x_y_z __q__ ***w***") == [(0, 9, 2), (4, 6, 1), (12, 14, 1), (22, 25, 2), (28, 34, 1), (29, 32, 2)]
    assert flanking.pairs("*a `*` b*") == [(0, 8, 1)] and flanking.pairs("* a *") == []

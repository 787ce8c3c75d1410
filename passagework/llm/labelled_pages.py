"""Labelled web pages for fitting: invented words in many layouts, from a fixed seed.

Blocks of the article carry a mark while the page is built and scanned, which becomes their label.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from passagework.llm.leaf_blocks import Block, leaf_blocks

MARK = "\x02"

#: Openings of the article, from clear to bare.
WRAPPERS = ("<article>", "<main><article>", "<main>", '<div class="content">', '<div id="main-content">',
            '<div class="post">', '<div class="entry-content">', '<section class="story">', '<div id="article-body">',
            '<div class="page"><div class="text">', "<div>", "<table><tr><td>", '<div role="main">',
            '<article class="post">', '<section id="content">')
#: Class words of what is not the article.
ASIDES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sidebar", "side", "related", "recommended",
          "share", "social", "newsletter", "subscribe", "signup", "cookie", "consent", "notice", "banner", "alert",
          "popup", "modal", "breadcrumb", "menu", "pagination", "tags", "widget", "toolbar", "disclaimer")
COMMENTS = ("comments", "comment", "replies", "responses", "discussion", "respond")
PAGE_FOOTS = ("footer", "copyright", "legal", "bottom", "colophon")
PAGE_HEADS = ("header", "masthead", "top", "logo", "branding")


def _word(rng: random.Random) -> str:
    word = "".join(rng.choices("etaoinshrdlucmwyéü", k=rng.choice((1, 2, 3, 3, 4, 5, 6, 8, 11))))
    return word + rng.choice(("###", "***", "!!")) if rng.random() < 0.03 else word


def _sentence(rng: random.Random, most: int = 25) -> str:
    words = " ".join(_word(rng) for _ in range(rng.randint(1, most)))
    return words.capitalize() + rng.choice((".", ".", ".", "?", "!", ":"))


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 4, 8, 20))))
    if rng.random() < 0.1:
        text = rng.choice(("###", "!!", "| ")).join(text.split())
    if rng.random() < 0.15:
        text = text.rstrip(".?!:")
    if rng.random() < 0.15:
        words = text.split()
        at = rng.randrange(len(words))
        words[at] = f'<a href="/x">{words[at]}</a>'
        text = " ".join(words)
    return text


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{" ".join(_word(rng) for _ in range(rng.randint(1, 4)))}</a></li>'
                   for i in range(n))


def _named(rng: random.Random, names: tuple[str, ...]) -> str:
    name = rng.choice(names)
    form = rng.choice(("{}", "{}", "{}-box", "site-{}", "{} wide", "c_{}"))
    return f'{rng.choice(("class", "class", "class", "id"))}="{form.format(name)}"'


def _aside(rng: random.Random) -> str:
    """One part that is not the article."""
    body = rng.choice((lambda: _sentence(rng), lambda: f"<p>{_prose(rng)}</p>", lambda: f"<ul>{_links(rng, 4)}</ul>",
                       lambda: f"<h3>{_sentence(rng, 4)}</h3><p>{_sentence(rng)}</p>",
                       lambda: f'<a href="/y">{_sentence(rng, 6)}</a>'))
    kind = rng.randrange(10)
    if kind < 6:
        tag = rng.choice(("div", "div", "div", "section", "aside", "p", "ul"))
        return f"<{tag} {_named(rng, ASIDES)}>{_sentence(rng) if tag in ('p', 'ul') else body()}</{tag}>"
    if kind == 6:
        return f"<aside>{body()}</aside>"
    if kind == 7:
        return f"<form><label>{_sentence(rng, 4)}</label><input><button>{_word(rng)}</button><p>{_sentence(rng)}</p></form>"
    if kind == 8:
        return f"<nav><ul>{_links(rng, rng.randint(2, 9))}</ul></nav>"
    return f"<div><ul>{_links(rng, rng.randint(3, 9))}</ul></div>"


def _comments(rng: random.Random) -> str:
    inner = "".join(rng.choice((f"<div {_named(rng, COMMENTS)}><p>{_prose(rng)}</p></div>",
                                f"<li><b>{_word(rng)}</b> {_prose(rng)}</li>", f"<p>{_prose(rng)}</p>"))
                    for _ in range(rng.randint(1, 5)))
    return f"<{(tag := rng.choice(('div', 'section', 'ol')))} {_named(rng, COMMENTS)}>{inner}</{tag}>"


def _part(rng: random.Random, bare: bool) -> str:
    """One part of the article. In a layout without names, only prose can be told from the rest."""
    kind = rng.randrange(20)
    if kind < 14 or bare:
        opened = rng.choice(("<p>", "<p>", "<p>", "<p><b>", '<p class="first">'))
        return f"{opened}{MARK}{_prose(rng)}{rng.choice(('</p>', '</p>', '</p>', '<br>'))}"
    if kind == 14:
        return f"<h2>{MARK}{_sentence(rng, 6).rstrip('.')}</h2>"
    if kind == 15:
        return "<ul>" + "".join(f"<li>{MARK}{_sentence(rng)}</li>" for _ in range(3)) + "</ul>"
    if kind == 16:
        return f"<blockquote><p>{MARK}{_prose(rng)}</p></blockquote>"
    if kind == 17:
        return f"<pre>{MARK}{_prose(rng)}</pre>"
    if kind == 18:
        return "<table>" + "".join(f"<tr><td>{MARK}{_word(rng)}</td><td>{MARK}{_sentence(rng, 4)}</td></tr>"
                                   for _ in range(2)) + "</table>"
    return f"<div>{MARK}{_prose(rng)}</div>"


def _page(rng: random.Random) -> str:
    wrapper = rng.choice(WRAPPERS)
    bare = wrapper in ("<div>", "<table><tr><td>")
    closed = "".join(f"</{x.split()[0].strip('<>')}>" for x in reversed(wrapper.replace("><", ">\n<").split("\n")))
    out = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
    if rng.random() < 0.4:
        out.append(f"<header><h1>{_sentence(rng, 4)}</h1><p>{_sentence(rng, 6)}</p></header>" if rng.random() < 0.5
                   else f"<div {_named(rng, PAGE_HEADS)}><a href='/'>{_word(rng)}</a> {_sentence(rng, 8)}</div>")
    if rng.random() < 0.8:
        out.append(f"<nav><ul>{_links(rng, rng.randint(3, 9))}</ul></nav>")
    out += [_aside(rng) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.97:
        out.append(wrapper)
        if rng.random() < 0.8:
            title = f"<h1>{MARK}{_sentence(rng, 9).rstrip('.')}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.15 and not bare else title)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            out.append(_part(rng, bare))
            if rng.random() < 0.06 and not bare:
                out.append(_aside(rng))
        if rng.random() < 0.25 and not bare:
            out.append(_comments(rng))
        out.append(closed)
    if rng.random() < 0.25:
        out.append(_comments(rng))
    out += [_aside(rng) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.85:
        line = f"{rng.choice(('&copy; ', ''))}{_word(rng)} {rng.choice(('&middot; ', ''))}{_prose(rng)}"
        out.append(rng.choice((f"<footer>{line}</footer>", f"<footer><p>{line}</p><ul>{_links(rng, 3)}</ul></footer>",
                               f"<div {_named(rng, PAGE_FOOTS)}>{line}</div>")))
    return "".join(out) + rng.choice(("</body></html>", ""))


def labelled_pages(n: int, seed: int) -> Iterator[tuple[list[Block], list[bool]]]:
    """``n`` pages as (blocks, whether each belongs to the article)."""
    rng = random.Random(seed)
    for _ in range(n):
        blocks = leaf_blocks(_page(rng))
        labels = [MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        pairs = [(b, yes) for b, yes in zip(blocks, labels, strict=True) if b.text]
        yield [b for b, _ in pairs], [yes for _, yes in pairs]

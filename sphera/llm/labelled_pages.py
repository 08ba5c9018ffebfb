"""Labelled pages for training the page segmenter: made up from a seed, in many layouts.

Each page is a list of (html, is_main) pieces in order; a piece that only opens or closes elements has None. Words are invented,
so nothing but tags, attributes, lengths, links and punctuation can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka ro mi ten sul vor lin dra pe os un cha bel tir mo na fe gra wi zu".split()
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="post">', '<section class="entry-content">', '<div class="article-body">', '<article class="post">', '<div itemprop="articleBody">']
_AD = ['<div class="ad">', '<div class="ads banner">', '<div id="sponsor">', '<aside class="promo">', '<div class="advert">', '<section class="sponsored">']
_NOTICE = ['<div class="cookie-notice">', '<div id="consent">', '<div role="alert" class="notice">', '<div class="gdpr banner">', '<div class="newsletter popup">']
_SIDE = ["<aside>", '<div class="sidebar">', '<div id="secondary" class="widget-area">', '<aside class="related">', '<section class="recommended">']
_TALK = ['<section id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div id="discussion" class="replies">']
_MENU = ["<nav>", '<ul class="menu">', '<div id="navigation">', '<div class="breadcrumb">', '<nav class="navbar">']


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(_SYLLABLES, k=r.choice((1, 2, 2, 3)))) for _ in range(n)]


def _sentence(r: random.Random, n: int) -> str:
    w = _words(r, max(1, n))
    for i in range(len(w)):
        if r.random() < 0.05:
            w[i] += r.choice((",", "!!", "***", "&amp;", ";"))
        if r.random() < 0.03:
            w[i] = f"<{(t := r.choice(('b', 'i', 'em', 'a', 'span', 'code')))}>{w[i]}</{t}>"
    text = " ".join(w)
    if r.random() < 0.1:
        text = text.upper().replace("</B>", "</b>")
    return text[:1].upper() + text[1:] + r.choice((".", ".", ".", "!", "?", "", ":"))


def _prose(r: random.Random) -> str:
    return " ".join(_sentence(r, r.choice((1, 3, 8, 14, 25))) for _ in range(r.choice((1, 1, 2, 4, 7))))


def _close(tag: str) -> str:
    return f"</{tag[1:].split()[0].rstrip('>')}>"


def _boxed(tag: str, inner: list[tuple[str, bool]]) -> list[tuple[str, bool | None]]:
    return [(tag, None), *inner, (_close(tag), None)]


def _links(r: random.Random) -> list[tuple[str, bool]]:
    item = r.choice(("<li>{}</li>", "<div>{}</div>", "<p>{}</p>"))
    return [(item.format(f'<a href="/{w}">{w}</a>'), False) for w in _words(r, r.randint(2, 7))]


def _short(r: random.Random) -> list[tuple[str, bool]]:
    kind = r.choice(("<p>{}</p>", "{}<br>", "<div>{}</div>", "<span>{}</span><hr>"))
    return [(kind.format(_sentence(r, r.choice((3, 6, 12, 25)))), False) for _ in range(r.choice((1, 1, 2)))]


def _comments(r: random.Random) -> list[tuple[str, bool | None]]:
    out: list[tuple[str, bool | None]] = [("<h3>" + _sentence(r, 2) + "</h3>", False)]
    for _ in range(r.randint(1, 4)):
        box = r.choice(('<div class="comment">', "<li>", '<article class="comment">', '<div class="reply">'))
        out += _boxed(box, [(f'<span class="author">{_words(r, 1)[0]}</span><br>', False), (f"<p>{_prose(r)}</p>", False)])
    return out


def _form(r: random.Random) -> list[tuple[str, bool]]:
    return [(f"<label>{_sentence(r, 2)}</label>", False), ('<input type="text" name="q">', False), (f"<button>{_words(r, 1)[0]}</button>", False)]


def _body(r: random.Random) -> list[tuple[str, bool | None]]:
    out: list[tuple[str, bool | None]] = []
    if r.random() < 0.8:
        head = (f"<h1>{_sentence(r, r.randint(1, 9))}</h1>", True)
        out += _boxed("<header>", [head]) if r.random() < 0.15 else [head]
    for _ in range(r.choice((1, 2, 4, 6, 10))):
        kind = r.random()
        if kind < 0.72:
            out.append((r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br></p>")).format(_prose(r)), True))
        elif kind < 0.8:
            out.append((f"<h2>{_sentence(r, 3)}</h2>", True))
        elif kind < 0.88:
            out += _boxed(r.choice(("<ul>", "<ol>")), [(f"<li>{_sentence(r, r.choice((2, 6, 12)))}</li>", True) for _ in range(r.randint(2, 5))])
        elif kind < 0.92:
            out.append((f"<blockquote>{_prose(r)}</blockquote>", True))
        elif kind < 0.95:
            out.append((f"<pre>{_prose(r)}</pre>", True))
        else:
            out += _boxed("<table>", [(f"<tr><td>{a}</td></tr>", True) for a in _words(r, 3)])
        if r.random() < 0.06:
            out += _boxed(r.choice(_AD), _short(r))
        if r.random() < 0.03:
            out += _boxed(r.choice(_SIDE), _links(r) if r.random() < 0.5 else _short(r))
    if r.random() < 0.12:
        out += _boxed(r.choice(_TALK), _comments(r))
    if r.random() < 0.08:
        out += _boxed('<form action="/x">', _form(r))
    return out


def page(r: random.Random) -> list[tuple[str, bool | None]]:
    out: list[tuple[str, bool | None]] = []
    if r.random() < 0.3:
        out += _boxed(r.choice(_NOTICE), _short(r))
    if r.random() < 0.45:
        out += _boxed(r.choice(("<header>", '<div id="header">')), _short(r) + (_boxed(r.choice(_MENU), _links(r)) if r.random() < 0.5 else []))
    if r.random() < 0.75:
        out += _boxed(r.choice(_MENU), _links(r))
    if r.random() < 0.15:
        out += _boxed('<form class="search">', _form(r))
    if r.random() < 0.5:
        out += _boxed(r.choice(_AD), _short(r))
    if r.random() < 0.25:
        out += _boxed(r.choice(_SIDE), (_links(r) if r.random() < 0.6 else _short(r)))
    out += _boxed(r.choice(_MAIN), _body(r))
    if r.random() < 0.3:
        out += _boxed(r.choice(_SIDE), (_links(r) if r.random() < 0.6 else [(f"<p>{_prose(r)}</p>", False)]))
    if r.random() < 0.25:
        out += _boxed(r.choice(_TALK), _comments(r))
    if r.random() < 0.2:
        out += _boxed(r.choice(_AD), _short(r))
    if r.random() < 0.85:
        out += _boxed(r.choice(("<footer>", '<div id="footer">', '<div class="site-footer">')), [("&copy; " + _sentence(r, 4), False)] + (_links(r) if r.random() < 0.3 else []))
    return out


def pages(n: int, seed: int = 3) -> list[list[tuple[str, bool | None]]]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]

"""Labelled training pages for the HTML extractor, composed from a seed.

A page is a list of (html, main) fragments inside some layout; fragments marked main are the article. The words are made
up from syllables, so nothing but structure and the shape of texts can be learned.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas vo el un dar shi po qua zel an ti mor ble ost".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 6, high: int = 24) -> str:
    mark = r.choice([""] * 8 + ["!!", "***", "###"])
    words = [_word(r) + mark for _ in range(r.randint(low, high))]
    text = " ".join(words)
    return (text.upper() if r.random() < 0.08 else text.capitalize()) + r.choice(["."] * 6 + ["!", "?", ""])


def _paragraph(r: random.Random) -> str:
    if r.random() < 0.2:
        return _sentence(r, 1, 4)
    text = " ".join(_sentence(r) for _ in range(r.randint(1, 6)))
    if r.random() < 0.25:
        words = text.split()
        at = r.randrange(len(words))
        words[at] = f'<a href="/{words[at]}">{words[at]}</a>' if r.random() < 0.5 else f"<b>{words[at]}</b>"
        text = " ".join(words)
    return text.replace(" & ", " &amp; ")


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    items = "".join(f'<{tag}><a href="/{_word(r)}">{_word(r)} {_word(r) if r.random() < 0.4 else ""}</a></{tag}>' for _ in range(n))
    return f"<ul>{items}</ul>" if tag == "li" else items


def _article(r: random.Random) -> list[str]:
    out = [f"<h1>{_sentence(r, 2, 9)}</h1>"] if r.random() < 0.85 else []
    if r.random() < 0.2:
        out.append(f"<p><b>{_paragraph(r)}<br>")
    for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8])):
        kind = r.random()
        if kind < 0.68:
            out.append(f"<p>{_paragraph(r)}" + ("</p>" if r.random() < 0.85 else ""))
        elif kind < 0.76:
            out.append(f"<h{r.randint(2, 4)}>{_sentence(r, 2, 6)}</h2>")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, 2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.87:
            out.append(f"<blockquote><p>{_paragraph(r)}</p></blockquote>")
        elif kind < 0.91:
            out.append("<table>" + "".join(f"<tr><td>{_word(r)}</td><td>{_word(r)} {r.randint(1, 99)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
        elif kind < 0.95:
            out.append(f"<pre>{_word(r)} = {_word(r)}({r.randint(0, 9)})</pre>")
        else:
            out.append(f"<figure><img src=x><figcaption>{_sentence(r, 3, 8)}</figcaption></figure>")
    return out


def _hint(r: random.Random, *names: str) -> str:
    name = r.choice(names)
    return r.choice([f'class="{name}"', f'id="{name}"', f'class="{_word(r)} {name}"', f'class="{name}-{_word(r)}"'])


def _side(r: random.Random, kind: str) -> str:
    if kind == "nav":
        return r.choice([f"<nav>{_links(r, r.randint(3, 7))}</nav>", f"<div {_hint(r, 'menu', 'navbar', 'breadcrumb', 'nav')}>{_links(r, r.randint(3, 6), 'span')}</div>", f'<div role="navigation">{_links(r, 4)}</div>'])
    if kind == "header":
        return r.choice([f"<header><a href=/>{_word(r)}</a><p>{_sentence(r, 3, 8)}</p></header>", f"<div {_hint(r, 'header', 'masthead', 'banner')}><h2>{_word(r)} {_word(r)}</h2>{_sentence(r, 3, 8)}</div>"])
    if kind == "footer":
        return r.choice([f"<footer>&copy; {_word(r)}.example &middot; {_sentence(r)} {_sentence(r)}</footer>", f"<div {_hint(r, 'footer', 'copyright')}><p>&copy; 2020 {_word(r)}. {_sentence(r)}</p>{_links(r, 3)}</div>", f"<footer><p>{_paragraph(r)}</p></footer>"])
    if kind == "ad":
        return r.choice([f'<div class="ad">{_sentence(r)}</div>', f"<div {_hint(r, 'advert', 'ads', 'sponsored', 'promo', 'advertisement')}><p>{_paragraph(r)}</p></div>", f"<aside {_hint(r, 'ad', 'ads')}>{_sentence(r)}</aside>"])
    if kind == "aside":
        return r.choice([f"<aside><h3>{_word(r)}</h3>{_links(r, 4)}</aside>", f"<div {_hint(r, 'sidebar', 'related', 'widget', 'recommended')}><h3>{_word(r)}</h3>{_links(r, 3)}<p>{_paragraph(r)}</p></div>", f"<aside><p>{_paragraph(r)}</p></aside>"])
    if kind == "notice":
        return r.choice([f"<div {_hint(r, 'cookie', 'notice', 'consent', 'gdpr', 'popup', 'newsletter')}><p>{_paragraph(r)}</p><button>{_word(r)}</button></div>", f'<div role="dialog">{_sentence(r)}</div>', f'<div role="alert"><p>{_sentence(r)}</p></div>'])
    if kind == "form":
        return f"<form action=/><label>{_word(r)}</label><input name=q><select><option>{_word(r)}</option><option>{_word(r)}</option></select><textarea>{_sentence(r)}</textarea><button>{_word(r)}</button></form>"
    if kind == "share":
        return f"<div {_hint(r, 'share', 'social', 'tags')}>{_links(r, 3, 'span')}</div>"
    return f"<{(t := r.choice(['section', 'div', 'ol']))} {_hint(r, 'comments', 'comment', 'replies', 'discussion')}><h3>{r.randint(1, 40)} {_word(r)}</h3>" + "".join(f'<div class="comment"><b>{_word(r)}</b><p>{_paragraph(r)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>"


#: Names of boxes that are not the article: one word of a class, id or role tells them wherever they stand.
BOXES = {
    "comments": "comments comment replies reply responses respond discussion disqus reactions feedback commentlist",
    "aside": "sidebar related widget recommended recommendations popular trending aside rail teaser more readmore",
    "notice": "cookie notice consent gdpr popup newsletter signup subscribe subscription modal paywall alert overlay",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense",
    "share": "share social tags sharing follow",
    "nav": "menu navbar nav breadcrumb breadcrumbs pagination toc navigation",
    "footer": "footer copyright colophon legal",
}


def _box(r: random.Random) -> str:
    """A box of paragraphs like the article's: nothing but its name tells it apart."""
    names = BOXES[r.choice(list(BOXES))].split()
    names = names[:2] if r.random() < 0.4 else names
    tag = r.choice(["div", "div", "section", "aside", "ul"] if r.random() < 0.8 else ["p"])
    inner = "".join(f"<p>{_paragraph(r)}</p>" for _ in range(r.choice([1, 1, 1, 2, 3]))) if tag not in ("p", "ul") else _sentence(r) if tag == "p" else f"<li>{_sentence(r)}</li><li>{_sentence(r)}</li>"
    hint = r.choice([f'class="{r.choice(names)}-{r.choice(names)}"', f'class="{_word(r)}_{r.choice(names)}"', _hint(r, *names), _hint(r, *names)])
    return f"<{tag} {hint}>{inner}</{tag}>"


def _bare(r: random.Random) -> list[tuple[str, bool]]:
    """A page of text without an article's element, or without any element."""
    head = r.choice(["", "<html><body>", "<body>", "<html><head></head><body>"])
    if r.random() < 0.4:
        return [(head, False), (" ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 5]))), True)]
    return [(head, False), *((f"<p>{_paragraph(r)}</p>", True) for _ in range(r.choice([1, 1, 2, 3])))]


def pages(count: int = 400, seed: int = 11) -> list[list[tuple[str, bool]]]:
    """Pages as fragments in order, each with whether its text is main text."""
    r, out = random.Random(seed), []
    for _ in range(count):
        before = [k for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.45]
        after = [k for k in ("share", "comments", "aside", "ad", "nav", "form", "footer") if r.random() < (0.7 if k == "footer" else 0.35)]
        r.shuffle(before)
        if r.random() < 0.3:
            r.shuffle(after)
        open_, close = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("<section>", "</section>")])
        body = [(x, True) for x in _article(r)]
        for kind in ("ad", "aside", "share", "form", "comments"):
            if r.random() < 0.12:
                at = r.randint(1, len(body)) if kind in ("ad", "aside") else len(body)
                body.insert(at, (_side(r, kind), False))
        for at, share in ((len(body), 0.3), (r.randint(0, len(body)), 0.3)):
            if r.random() < share:
                body.insert(at, (_box(r), False))
        front, behind = ([(_box(r), False) for _ in range(r.choice([1, 1, 2]))] if r.random() < share else [] for share in (0.45, 0.7))
        head = f"<!DOCTYPE html><html><head><title>{_sentence(r, 2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        out.append([(head, False), *((_side(r, k), False) for k in before), *front, (open_, False), *body, (close, False), *behind, *((_side(r, k), False) for k in after), ("</body></html>" if r.random() < 0.9 else "", False)])
    return out + [_bare(r) for _ in range(count // 16)]

"""Labelled pages that train the page model: fixed building blocks put together by a seeded generator.

Every element of a block says whether the text in it is content (data-label 1) or not (0); the labels
are taken off before features are made.
"""

from __future__ import annotations

import random

WORDS = ("time people way water day part sound work place year back thing name sentence line boy farm end "
         "letter point mother world need house picture animal study page answer plant school").split()

#: what surrounds an article: page furniture, adverts, notices, forms and reader comments
FURNITURE = [
    '<nav data-label="0"><ul>{links}</ul></nav>',
    '<div class="menu" data-label="0"><ul>{links}</ul></div>',
    '<div id="navigation" role="navigation" data-label="0">{inline}</div>',
    '<div class="breadcrumb" data-label="0">{inline}</div>',
    '<header data-label="0"><h2>{s}</h2><p>{s}</p></header>',
    '<div id="header" class="site-header" data-label="0"><h1><a href="/">{s}</a></h1></div>',
    '<footer data-label="0">&copy; {s} {p}</footer>',
    '<footer data-label="0"><p>{p}</p><ul>{links}</ul></footer>',
    '<div class="footer" data-label="0"><p>{p}</p></div>',
    '<aside data-label="0"><h3>{s}</h3><p>{p}</p></aside>',
    '<div class="sidebar" data-label="0"><h3>{s}</h3><ul>{links}</ul><p>{p}</p></div>',
    '<div class="related" data-label="0"><h3>{s}</h3><ul>{links}</ul></div>',
    '<div class="ad" data-label="0">{p}</div>',
    '<div class="ads banner" data-label="0"><p>{p}</p></div>',
    '<div class="advert sponsored" data-label="0"><a href="/x">{s}</a> {p}</div>',
    '<div class="cookie notice" data-label="0"><p>{p}</p><button>{s}</button></div>',
    '<div class="notice" role="alert" data-label="0">{p}</div>',
    '<form data-label="0"><label>{s}</label><input type="text"><button>{s}</button><p>{p}</p></form>',
    '<div class="share social" data-label="0">{inline}</div>',
    '<div class="newsletter" data-label="0"><p>{p}</p><form><input></form></div>',
    '<section id="comments" class="comments" data-label="0"><h3>{s}</h3><div class="comment"><p>{p}</p><p>{p}</p></div>'
    '<div class="comment"><p>{p}</p></div></section>',
    '<div class="comment-list" data-label="0"><div class="comment">{p}</div><div class="comment">{p}</div></div>',
    '<ul data-label="0">{links}</ul>',
]

#: what an article is made of
CONTENT = ["<p>{p}</p>", "<p>{p}<br>{p}</p>", "<p>{s}.</p>", "<p>{p} <a href='/r'>{w}</a> {p}</p>", "<h2>{s}</h2>", "<h3>{s}</h3>",
           "<ul><li>{s}</li><li>{p}</li></ul>", "<ol><li>{s}</li><li>{s}</li></ol>", "<blockquote><p>{p}</p></blockquote>",
           "<p><b>{p}<br>", "<p><b>{s}</b> {p}</p>", "<div><p>{p}</p></div>", "<section><h2>{s}</h2><p>{p}</p></section>",
           "<pre><code>{s}</code></pre>", "<table><tr><td>{s}</td><td>{w}</td></tr></table>", "<p><em>{w}</em></p>", "{p}"]

WRAPPERS = ['<article data-label="1">{x}</article>', '<main data-label="1">{x}</main>', '<main><article data-label="1">{x}</article></main>',
            '<div class="content" data-label="1">{x}</div>', '<div id="main-content" data-label="1">{x}</div>',
            '<div class="post"><div class="entry-content" data-label="1">{x}</div></div>', '<div class="article-body" data-label="1">{x}</div>',
            '<div id="page"><div class="story text" data-label="1">{x}</div></div>', '<article class="post" data-label="1">{x}</article>']

HEADS = ["<title>{s}</title><style>p{{margin:0}}</style><script>var t=1;</script>", "<title>{s}</title>", "<meta charset='utf-8'><title>{s}</title>"]


def pages(count: int = 60, seed: int = 7) -> list[str]:
    pick = random.Random(seed)

    def sentence(low: int, high: int) -> str:
        words = [pick.choice(WORDS) for _ in range(pick.randint(low, high))]
        return " ".join(words).capitalize()

    def fill(block: str) -> str:
        links = lambda form: "".join(form.format(sentence(1, 3)) for _ in range(pick.randint(2, 7)))
        parts = block.replace("{links}", links('<li><a href="/l">{}</a></li>')).replace("{inline}", links('<a href="/l">{}</a> '))
        while "{" in parts and any(k in parts for k in ("{p}", "{s}", "{w}")):
            long = ". ".join(sentence(4, 18) for _ in range(pick.choice((1, 1, 2, 3, 6)))) + "."
            parts = parts.replace("{p}", long, 1).replace("{s}", sentence(2, 7), 1).replace("{w}", sentence(1, 2), 1)
        return parts

    out = []
    for _ in range(count):
        title = "<h1>{s}</h1>" if pick.random() < 0.8 else ""
        body = [fill(pick.choice(CONTENT)) for _ in range(pick.choice((1, 1, 2, 4, 8)))]
        inside = [fill(pick.choice(FURNITURE)) for _ in range(pick.choice((0, 0, 0, 1)))]
        article = pick.choice(WRAPPERS).replace("{x}", fill(title) + "".join(body + inside))
        before = [fill(pick.choice(FURNITURE)) for _ in range(pick.randint(1, 4))]
        after = [fill(pick.choice(FURNITURE)) for _ in range(pick.randint(1, 4))]
        tail = "</body></html>" if pick.random() < 0.8 else ""
        out.append(f'<!DOCTYPE html><html><head data-label="0">{fill(pick.choice(HEADS))}</head><body>'
                   f"{''.join(before)}{article}{''.join(after)}{tail}")
    return out

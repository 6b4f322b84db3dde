"""Generated pages of many layouts, whose main text is known: what the node classifier of html_text.py learns from."""

from __future__ import annotations

import random

PAGES, SEED = 320, 11
_SYLLABLES = "an ba co de el fi go hu in jo ka le mi no or pa qui re so ta un ver wo ya zi tion ment ing able".split()
_LINKS = "Home About News Sports Contact Archive Login Shop Help Blog Events Team Jobs Privacy Terms Map".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))


def _sentence(r: random.Random, n: int | None = None) -> str:
    words = [_word(r) for _ in range(n or r.randint(3, 22))]
    if len(words) > 8 and r.random() < 0.5:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + r.choice("....!?")


def _prose(r: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


class _Page:
    """Main text carries a mark in each block; marks are words that nothing else holds."""

    def __init__(self, r: random.Random):
        self.r, self.marks = r, []

    def main(self, text: str) -> str:
        mark = f"qx{len(self.marks)}zk{self.r.randint(0, 999)}q"
        self.marks.append(mark)
        at = text.find(" ")
        return f"{text[:at]} {mark}{text[at:]}" if at > 0 else f"{text} {mark}"

    def attr(self, *names: str) -> str:
        r = self.r
        name = r.choice(names)
        name = r.choice([name, f"{name}-{_word(r)}", f"{_word(r)}_{name}", name.capitalize(), f"site-{name}"])
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{_word(r)} {name}"', f" class='{name}'", f" class={name}"])

    def links(self, n: int) -> str:
        r = self.r
        some = [r.choice([r.choice(_LINKS), _word(r), _word(r) + ",", " ".join(_word(r) for _ in range(r.randint(2, 6)))]) for _ in range(n)]
        if r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in some) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(f'<a href="/{x}">{x}</a>' for x in some)

    def inline(self, text: str) -> str:
        r = self.r
        words = text.split(" ")
        if len(words) > 4 and r.random() < 0.35:
            i = r.randrange(len(words) - 1)
            words[i] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<i>{}</i>", "<b>{}"]).format(words[i])
        if r.random() < 0.1:
            words.insert(len(words) // 2, "<br>")
        return " ".join(words)

    def noise(self) -> str:
        """One part that is not main text."""
        r = self.r
        kind = r.choice("nav ad side foot note form comments share head related hidden".split())
        tag = lambda semantic: r.choice([semantic, "div", "div", "section"])
        text = r.choice([_sentence(r), _prose(r, 3)])
        if kind == "nav":
            t = tag("nav")
            return f"<{t}{self.attr('nav', 'menu', 'breadcrumb', 'navbar', 'pagination') if t != 'nav' or r.random() < 0.4 else ''}>{self.links(r.randint(2, 9))}</{t}>"
        if kind == "ad":
            t = tag("aside")
            return f"<{t}{self.attr('ad', 'ads', 'advert', 'sponsor', 'promo', 'advertisement')}>{r.choice([text, f'<p>{text}</p>', f'<a href=/x>{text}</a>'])}</{t}>"
        if kind == "side":
            t = tag("aside")
            body = r.choice([f"<h3>{_sentence(r, 3)}</h3>{self.links(5)}", f"<h2>{_sentence(r, 2)}</h2><p>{text}</p>", f"<p>{text}</p>"])
            return f"<{t}{self.attr('sidebar', 'widget', 'aside', 'rail') if t != 'aside' or r.random() < 0.4 else ''}>{body}</{t}>"
        if kind == "foot":
            t = tag("footer")
            return f"<{t}{self.attr('footer', 'copyright', 'colophon') if t != 'footer' or r.random() < 0.3 else ''}>{r.choice(['&copy; ', '', '(c) 2020 '])}{text} {r.choice(['', self.links(3)])}</{t}>"
        if kind == "note":
            return f"<div{self.attr('cookie', 'consent', 'notice', 'newsletter', 'popup', 'subscribe', 'alert', 'paywall')}><p>{text}</p>{r.choice(['', '<button>OK</button>'])}</div>"
        if kind == "form":
            return f"<form action=/q{self.attr('search', 'form', 'login', 'contact') if r.random() < 0.5 else ''}><label>{_sentence(r, 2)}</label><input name=q><p>{text}</p></form>"
        if kind == "comments":
            t = tag("section")
            each = "".join(r.choice([f"<div{self.attr('comment', 'reply')}><b>{_word(r)}</b><p>{_prose(r, 4)}</p></div>", f"<li><p>{_prose(r, 3)}</p></li>"]) for _ in range(r.randint(1, 4)))
            return f"<{t}{self.attr('comments', 'discussion', 'respond', 'replies')}><h3>{_sentence(r, 2)}</h3>{each}</{t}>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'follow')}>{self.links(3)}</div>"
        if kind == "head":
            t = tag("header")
            return f"<{t}{self.attr('header', 'masthead', 'banner') if t != 'header' or r.random() < 0.3 else ''}>{r.choice([f'<h1>{_sentence(r, 2)}</h1>', f'<div>{_sentence(r, 3)}</div>', f'<p>{text}</p>'])}{r.choice(['', self.links(4)])}</{t}>"
        if kind == "related":
            return f"<div{self.attr('related', 'recommended', 'popular', 'more', 'trending')}><h3>{_sentence(r, 3)}</h3><ul>" + "".join(f'<li><a href="/">{_sentence(r)}</a></li>' for _ in range(r.randint(2, 5))) + "</ul></div>"
        return f'<div{r.choice([" hidden", " style=display:none", chr(32) + "aria-hidden=true"])}><p>{text}</p></div>'

    def block(self) -> str:
        r = self.r
        kind = r.choice(["p"] * 10 + ["short", "h2", "list", "list", "quote", "table", "pre", "open", "bold"])
        if kind == "short":
            return f"<p>{self.main(_sentence(r, r.randint(1, 4)))}</p>"
        if kind == "h2":
            return f"<h{(k := r.choice('234'))}>{self.main(_sentence(r, r.randint(2, 7)))}</h{k}>"
        if kind == "list":
            brief = r.random() < 0.5
            items = (_sentence(r, r.randint(1, 4)).rstrip(".!?") if brief else _sentence(r) for _ in range(r.randint(1, 6)))
            return f"<{(k := r.choice(['ul', 'ul', 'ol']))}>" + "".join(f"<li>{self.inline(self.main(x))}{r.choice(['</li>', ''])}" for x in items) + f"</{k}>"
        if kind == "quote":
            return f"<blockquote><p>{self.main(_prose(r, 3))}</p></blockquote>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.main(_sentence(r, 2))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if kind == "pre":
            return f"<pre>{self.main(_sentence(r, 6))}</pre>"
        if kind == "open":
            return f"<p>{self.inline(self.main(_prose(r)))}"
        if kind == "bold":
            return f"<p><b>{self.main(_sentence(r))}<br><p>{self.main(_prose(r, 3))}</p>"
        return f"<p>{self.inline(self.main(_prose(r, 8)))}</p>"

    def build(self) -> str:
        r = self.r
        title = _sentence(r, r.randint(1, 9))
        body = "".join(self.block() + (self.noise() if r.random() < 0.05 else "") for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9, 16])))
        heading = f"<h1>{self.main(title)}</h1>" if r.random() < 0.85 else ""
        if not body and not heading:
            heading = f"<h1>{self.main(title)}</h1>"
        inner = heading + body
        if r.random() < 0.15:
            inner += self.noise()
        shape = r.random()
        if shape < 0.45:
            core = f"<article>{inner}</article>"
        elif shape < 0.6:
            core = f"<main>{r.choice(['', self.noise()])}<article{self.attr('post', 'entry', 'article')}>{inner}</article></main>"
        elif shape < 0.7:
            core = f"<main>{inner}</main>"
        elif shape < 0.9:
            core = f"<div{self.attr('content', 'main', 'article', 'post', 'entry', 'story')}>{inner}</div>"
        else:
            core = f"<div{self.attr('content', 'main', 'body')}><div{self.attr('article', 'post', 'text')}>{inner}</div>{r.choice(['', self.noise()])}</div>"
        before = "".join(self.noise() for _ in range(r.randint(0, 4)))
        after = "".join(self.noise() for _ in range(r.randint(0, 4)))
        middle = before + core + after
        if r.random() < 0.4:
            middle = f"<div{self.attr('wrapper', 'page', 'container', 'layout')}>{middle}</div>"
        tail = r.choice(["</body></html>", "", "</html>"])
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{middle}{tail}"


def generate(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages, and the marks that each block of their main text holds."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        page = _Page(r)
        out.append((page.build(), page.marks))
    return out

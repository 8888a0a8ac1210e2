"""Training pages for the block labeller: random pages whose main blocks are known.

Pages are put together from a seed: frames with headers, menus, sidebars,
notices, adverts, forms, comments and footers around an article, in the common
shapes and under the common names of such parts in several languages, or under
names that say nothing. Words are made up, so that a model learns from structure,
not from topics.
"""

from __future__ import annotations

import random

#: Names under which sites keep their parts (class or id words).
MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "body", "text", "page", "blog", "news", "single", "hentry", "prose", "markdown")
PART_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "pager", "tabs", "toc", "links", "skip", "hauptmenue", "brotkrumen", "navegacion", "ariane", "navigatie"),
    "head": ("header", "masthead", "banner", "logo", "branding", "tagline", "site", "top", "search", "kopfzeile", "kopfbereich", "entete", "cabecera", "intestazione", "encabezado"),
    "side": ("sidebar", "side", "widget", "aside", "rail", "related", "recommended", "popular", "trending", "archive", "tags", "categories", "teaser", "more", "author", "meta", "byline", "seitenleiste", "randspalte", "verwandt", "laterale", "relacionados", "connexes", "colonne"),
    "notice": ("cookie", "cookies", "consent", "notice", "alert", "gdpr", "privacy", "warning", "message", "popup", "modal", "overlay", "paywall", "disclaimer", "hinweis", "einwilligung", "aviso", "avviso", "avertissement", "datenschutz", "consentement"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner", "offer", "outbrain", "werbung", "anzeige", "reklame", "publicite", "publicidad", "anuncio", "pubblicita", "annonce"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact", "share", "social", "follow", "poll", "survey", "register", "formular", "anmeldung", "formulaire", "formulario", "inscription", "suscribirse", "teilen", "umfrage"),
    "comment": ("comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "feedback", "reviews", "thread", "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios", "commenti", "antworten", "reacties"),
    "foot": ("footer", "foot", "copyright", "bottom", "colophon", "legal", "imprint", "credits", "sitemap", "fusszeile", "fussbereich", "impressum", "pied", "pie", "piedipagina", "mentions"),
}
#: The HTML elements that such parts have of their own, if any.
PART_TAGS = {"menu": "nav", "head": "header", "side": "aside", "form": "form", "foot": "footer", "notice": "dialog"}
UI_WORDS = (
    "home about contact news login register share tweet like reply subscribe newsletter cookies accept privacy policy terms menu search "
    "next previous more read comments posted by copyright all rights reserved sponsored advertisement related popular sign up follow us email "
    "submit send cancel close "
    "startseite kontakt anmelden teilen antworten datenschutz impressum suche weiter kommentar kommentare anzeige werbung rechte vorbehalten akzeptieren newsletter "
    "accueil connexion partager répondre confidentialité mentions recherche suivant commentaires publicité droits réservés accepter "
    "inicio contacto entrar compartir responder privacidad buscar siguiente comentarios publicidad derechos reservados aceptar suscribirse "
    "accetta accedi condividi rispondi cerca commenti pubblicità diritti riservati"
).split()


class PageMaker:
    """Random pages with labels, from a seed. ``page()`` gives HTML; main blocks' texts carry the mark ``MARK``."""

    MARK = "\x02"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghlmnprstvw") * self.r.randint(0, 1) + self.r.choice("aeiou") + self.r.choice(["", "n", "r", "s", "t"]) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.r.randint(1, 14)).capitalize() + self.r.choice("....?!") for _ in range(n))

    def short(self) -> str:
        r = self.r
        own = [r.choice(UI_WORDS) if r.random() < 0.5 else self.word() for _ in range(r.randint(1, 5))]
        return " ".join(own).capitalize()

    def names(self, kind: str | None) -> str:
        """A class or id attribute, often with words that say nothing."""
        r = self.r
        pool = MAIN_NAMES if kind == "main" else PART_NAMES.get(kind, ())
        own = [r.choice(pool) if r.random() < 0.8 else self.word()] if pool and (kind != "main" or r.random() < 0.7) else []
        if r.random() < 0.4:
            own.append(r.choice(["col", "row", "box", "wrap", "container", "inner", "clearfix", "block", "section", "left", "right", "item", "css", "js"]))
        if r.random() < 0.2:
            own.append(self.word() + str(r.randint(1, 99)))
        r.shuffle(own)
        glue = r.choice([" ", "-", "_"])
        return f' {r.choice(["class", "class", "class", "id"])}="{glue.join(own)}"' if own else ""

    def paragraph(self, text: str, mark: str) -> str:
        r, text = self.r, mark + text
        if r.random() < 0.15:
            at = r.randint(0, len(text) - 1)
            at = text.find(" ", at)
            if at > 0:
                text = text[:at] + r.choice([" <a href='/x'>", " <b>", " <em>", " <span>"]) + text[at + 1 :]
        return r.choice(["<p>{}</p>"] * 5 + ["<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p class='x'>{}</p>"]).format(text)

    def article_block(self) -> str:
        r, m = self.r, self.MARK
        kind = r.random()
        if kind < 0.72:
            return self.paragraph(self.sentences(r.choice([1, 1, 2, 3, 5, 8])), m)
        if kind < 0.82:
            level = r.randint(2, 4)
            return f"<h{level}>{m}{self.words(r.randint(1, 7)).capitalize()}</h{level}>"
        if kind < 0.9:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{m}{self.sentences(1) if r.random() < 0.6 else self.words(r.randint(1, 6))}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.95:
            return f"<blockquote>{self.paragraph(self.sentences(r.randint(1, 3)), m)}</blockquote>"
        if kind < 0.98:
            return f"<figure><img src='/i.png'><figcaption>{m}{self.sentences(1)}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{m}{self.word()}</td><td>{m}{self.words(2)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"

    def link_list(self) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{self.short() if self.r.random() < 0.5 else self.word()}</a></li>' for _ in range(self.r.randint(2, 9)))
        return f"<ul>{items}</ul>"

    def part(self, kind: str) -> str:
        """A part that isn't the article."""
        r = self.r
        if kind in ("menu", "foot", "side", "head") and r.random() < 0.6:
            inner = self.link_list()
            if kind in ("side", "foot") and r.random() < 0.4:
                inner = f"<h{r.randint(2, 5)}>{self.short()}</h3>" + inner
        elif kind == "comment":
            inner = "".join(f"<div{self.names('comment') if r.random() < 0.6 else ''}>" + (f"<span>{self.word().capitalize()}</span>" if r.random() < 0.5 else f"<h4>{self.word()}</h4>") + f"<p>{self.sentences(r.randint(1, 4))}</p></div>" for _ in range(r.randint(1, 5)))
            inner = f"<h3>{self.short()}</h3>" + inner if r.random() < 0.5 else inner
        elif kind == "form":
            inner = f"<label>{self.short()}</label><input name='q'><button>{self.short()}</button>"
            if r.random() < 0.5:
                inner = f"<p>{self.sentences(1)}</p>" + inner
        elif kind == "foot" and r.random() < 0.6:
            inner = f"&copy; {self.words(2)} &middot; {self.sentences(1)}"
        else:
            inner = r.choice([self.sentences(r.randint(1, 4)), f"<p>{self.sentences(r.randint(1, 3))}</p>", f"<p>{self.short()}</p>", f"<a href='/y'>{self.short()}</a>", f"<h4>{self.short()}</h4><p>{self.sentences(r.randint(1, 3))}</p>"])
        own = PART_TAGS.get(kind)
        if own and r.random() < 0.6:
            return f"<{own}{self.names(kind) if r.random() < 0.4 else ''}>{inner}</{own}>"
        tag = r.choice(["div", "div", "div", "section", "p" if "<" not in inner else "div", "aside" if kind in ("side", "advert", "notice") else "div"])
        return f"<{tag}{self.names(kind)}>{inner}</{tag}>"

    def page(self) -> str:
        r, m = self.r, self.MARK
        blocks = [self.article_block() for _ in range(r.choice([1, 1, 2, 4, 8, 14, 22]))]
        if r.random() < 0.8:
            blocks.insert(0, f"<h1>{m}{self.words(r.randint(1, 9)).capitalize()}</h1>")
        for _ in range(r.choice([0, 0, 0, 1, 2])):  # parts inside the article
            blocks.insert(r.randint(0, len(blocks)), self.part(r.choice(["advert", "side", "form", "notice", "menu"])))
        body = "".join(blocks)
        shape = r.random()
        if shape < 0.5:
            body = f"<article{self.names('main') if r.random() < 0.4 else ''}>{body}</article>"
        elif shape < 0.65:
            body = f"<main>{body}</main>"
        elif shape < 0.95:
            body = f"<div{self.names('main')}>{body}</div>"
        if r.random() < 0.3:
            body = f"<{r.choice(['main', 'section', 'div'])}{self.names('main')}>{body}" + (self.part("comment") if r.random() < 0.3 else "") + "</div>"
        before = [self.part(r.choice(["menu", "head", "notice", "advert", "menu"])) for _ in range(r.choice([0, 1, 2, 3]))]
        after = [self.part(r.choice(["side", "comment", "foot", "advert", "form", "notice", "comment"])) for _ in range(r.choice([0, 1, 2, 3]))]
        if r.random() < 0.7:
            after.append(self.part("foot"))
        if r.random() < 0.3:
            before.append(self.part("side"))
        whole = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            whole = f"<div{self.names(None)}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title></head><body>{whole}</body></html>"

"""Training pages for the block labeller: pages of the corpus taken apart and laid out anew, with the label of every block known.

A layout takes prose of sampled pages and set phrases and deals them over an article and the parts around it: menus, headers,
footers, sidebars, notices, adverts, forms and reader comments. Elements, class names, order and nesting vary, and names are
sometimes left out, so that no single name decides. ``data-y`` on an element says whether its blocks belong to the article.
"""

from __future__ import annotations

import html
import random

# Usual class names by part of a page, and usual phrases in four languages.
NAMES = {
    "article": "content post entry article story body post-content entry-content article-body story-body page-content main-content markdown prose text hentry",
    "menu": "nav menu navbar topnav main-menu navigation links tabs breadcrumb breadcrumbs pagination pager skip-links",
    "header": "header top masthead site-header branding logo page-header hero topbar",
    "footer": "footer foot bottom copyright colophon legal site-footer page-footer imprint",
    "sidebar": "sidebar side widget widget-area aside rail column-right popular trending related recommended more-stories tags author-box promo-list",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner ad-slot adsense ad-container partner",
    "notice": "cookie cookie-banner consent notice gdpr alert popup modal overlay message warning paywall announcement",
    "form": "newsletter subscribe signup search search-form login contact-form form poll",
    "comment": "comments comment comment-list discussion replies reply respond reader-comments responses feedback disqus",
    "plain": "row col box wrap wrapper container inner block module grid section layout page site outer clearfix",
}
TAGS = {
    "article": ["article", "main", "div", "div", "section"], "menu": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"],
    "sidebar": ["aside", "div", "section", "aside"], "advert": ["div", "aside", "section", "div"], "notice": ["div", "section", "aside", "div"],
    "form": ["form", "form", "div"], "comment": ["section", "div", "ol", "div"],
}
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Sports|Business|Politics|Culture|Products|Services|Blog|Archive|Login|Sign in|Help|FAQ|Shop|Startseite|Über uns|Kontakt|"
            "Nachrichten|Anmelden|Hilfe|Accueil|À propos|Actualités|Connexion|Inicio|Acerca de|Contacto|Noticias|Ayuda|Next|Previous|Read more|Skip to content",
    "header": "The Daily Post|My Blog|Welcome|News and views since 1998|Search|Menu|Tagesblatt|Le Journal|El Diario",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Alle Rechte vorbehalten.|Mentions légales|Tous droits réservés.|"
              "Aviso legal|Todos los derechos reservados.|Powered by WordPress|Follow us on Facebook|Contact us|Sitemap|Copyright",
    "sidebar": "Related articles|Most read|Popular posts|Trending now|You may also like|Recent posts|Categories|Tags|About the author|Ähnliche Artikel|Meistgelesen|"
               "Articles similaires|Les plus lus|Artículos relacionados|Lo más leído|Share this|Follow",
    "advert": "Advertisement|Sponsored|Buy now and save 50%|Limited time offer!|Get your free trial today|Anzeige|Jetzt kaufen|Publicité|Achetez maintenant|Publicidad|Compra ahora|Ad",
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our use of cookies.|Accept all|Reject|Please enable JavaScript to view this page.|"
              "Wir verwenden Cookies.|Alle akzeptieren|Nous utilisons des cookies.|Tout accepter|Utilizamos cookies.|Aceptar todo|You have 3 free articles left this month.",
    "form": "Subscribe to our newsletter|Enter your email address|Your name|Send|Submit|Sign up|Search|Password|Newsletter abonnieren|Absenden|Abonnez-vous|Envoyer|Suscríbete|Enviar",
    "comment": "Leave a comment|Reply|Report|3 comments|Comments|Great article, thanks!|I totally disagree with this.|First!|Anonymous says:|Posted 2 hours ago|Kommentare|Antworten|"
               "Danke für den Beitrag!|Commentaires|Répondre|Merci pour cet article|Comentarios|Responder|Log in to comment",
}
CHOICES = {k: v.split("|") for k, v in PHRASES.items()}
CLASSES = {k: v.split() for k, v in NAMES.items()}
BUILT_IN = [["The council met on Tuesday to discuss the plan.", "Members spoke for two hours before the vote, and the mayor promised an answer by the end of the month.",
             "The plan would change how streets are lit and cleaned."]]


class Layout:
    """One page's random choices."""

    def __init__(self, rng: random.Random, prose: list[list[str]]):
        self.rng, self.prose = rng, prose or BUILT_IN
        self.story = rng.choice(self.prose)
        self.named = rng.random() < 0.85
        self.semantic = rng.random() < 0.6

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, most: int) -> str:
        """Some words of any page."""
        text = self.rng.choice(self.rng.choice(self.prose)).split() or ["x"]
        at = self.rng.randrange(len(text))
        return " ".join(text[at:at + self.rng.randint(1, most)])

    def wrap(self, kind: str, inside: str, mark: int | None = None, tag: str | None = None) -> str:
        options = TAGS.get(kind, ["div"]) if self.semantic else ["div"]
        tag = tag or self.rng.choice(options)
        named = self.chance(0.95 if self.named or not self.semantic and kind != "article" else 0.4)
        said = [self.rng.choice(CLASSES[kind])] if named and (tag in ("div", "section", "ul", "ol") or self.chance(0.5)) else []
        said += [self.rng.choice(CLASSES["plain"])] if self.chance(0.2) else []
        self.rng.shuffle(said)
        where = "id" if len(said) == 1 and self.chance(0.3) else "class"
        names = f' {where}="{" ".join(said)}"' if said else ""
        return f"<{tag}{names}{'' if mark is None else f' data-y={chr(34)}{mark}{chr(34)}'}>{inside}</{tag}>"

    def text(self, s: str) -> str:
        return html.escape(s, quote=False)

    def phrase(self, kind: str) -> str:
        return self.text(self.rng.choice(CHOICES[kind]) if self.chance(0.6) else self.words(6))

    def links(self, kind: str, n: int) -> str:
        items = [f'<a href="/{i}">{self.phrase(kind)}</a>' for i in range(n)]
        shape = self.rng.randrange(4)
        return ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items),
                "".join(f"<p>{x}</p>" for x in items))[shape]

    def menu(self) -> str:
        return self.wrap("menu", self.links("menu", self.rng.randint(2, 9)), 0)

    def header(self) -> str:
        inside = self.rng.choice(["<h1>{}</h1>", "<div>{}</div>", '<a href="/">{}</a>', "<p>{}</p>"]).format(self.phrase("header"))
        inside += f"<p>{self.phrase('header')}</p>" if self.chance(0.4) else ""
        return self.wrap("header", inside + (self.menu() if self.chance(0.5) else ""), 0)

    def footer(self) -> str:
        inside = f"<p>{self.phrase('footer')}</p>" if self.chance(0.5) else f"&copy; {self.text(self.words(3))} &middot; {self.text(self.words(14))}"
        inside += self.links("footer", self.rng.randint(1, 5)) if self.chance(0.6) else ""
        return self.wrap("footer", inside, 0)

    def sidebar(self) -> str:
        head = "h3" if self.chance(0.6) else "h2"
        inside = f"<{head}>{self.phrase('sidebar')}</{head}>"
        inside += self.links("sidebar", self.rng.randint(1, 6)) if self.chance(0.7) else f"<p>{self.text(self.words(40))}</p>"
        return self.wrap("sidebar", inside, 0)

    def advert(self) -> str:
        inside = self.phrase("advert") if self.chance(0.4) else self.text(self.words(25))
        return self.wrap("advert", f"<p>{inside}</p>" if self.chance(0.3) else inside, 0)

    def notice(self) -> str:
        inside = f"<p>{self.phrase('notice')}</p>" if self.chance(0.6) else self.text(self.words(25))
        return self.wrap("notice", inside + (f"<button>{self.phrase('notice')}</button>" if self.chance(0.5) else ""), 0)

    def form(self) -> str:
        inside = "".join(f"<label>{self.phrase('form')}</label><input name=a>" for _ in range(self.rng.randint(1, 3)))
        return self.wrap("form", (f"<p>{self.phrase('form')}</p>" if self.chance(0.5) else "") + inside, 0)

    def comments(self) -> str:
        def one() -> str:
            body = self.rng.choice(CHOICES["comment"]) if self.chance(0.3) else self.words(60)
            name = "b" if self.chance(0.5) else "h4"
            who = f"<{name}>{self.text(self.words(2))}</{name}>" if self.chance(0.6) else ""
            return self.wrap("comment", f"{who}<p>{self.text(body)}</p>" + (f"<a href=#>{self.phrase('comment')}</a>" if self.chance(0.3) else ""), tag="li" if self.chance(0.2) else "div")
        return self.wrap("comment", (f"<h3>{self.phrase('comment')}</h3>" if self.chance(0.7) else "") + "".join(one() for _ in range(self.rng.randint(1, 6))), 0)

    def aside(self) -> str:
        return self.rng.choice([self.advert, self.advert, self.sidebar, self.form, self.notice])()

    def article(self) -> str:
        blocks = list(self.story)
        if self.chance(0.3):
            blocks = blocks[: self.rng.randint(1, max(1, len(blocks)))]
        head = f"<h1>{self.text(blocks[0][:60])}</h1>" if self.chance(0.8) else ""
        parts = []
        for b in blocks:
            s, kind = self.text(b), self.rng.random()
            if kind < 0.72:
                parts.append(f"<p>{s}</p>")
            elif kind < 0.78:
                parts.append(f"<p><b>{s}<br>")
            elif kind < 0.83:
                parts.append(f"<h2>{self.text(self.words(7))}</h2><p>{s}</p>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{self.text(self.words(14))}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{s}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<div>{s}</div>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=a><figcaption>{self.text(self.words(12))}</figcaption></figure><p>{s}</p>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(self.words(3))}</td><td>{self.text(self.words(3))}</td></tr>" for _ in range(3)) + "</table>")
            if self.chance(0.07):
                parts.append(self.aside())
            if self.chance(0.15):
                parts[-1] += f'<p>{self.text(self.words(12))} <a href="/x">{self.text(self.words(3))}</a> {self.text(self.words(12))}</p>'
        if self.chance(0.12):
            parts.append(self.comments())
        if self.chance(0.12):
            parts.append(self.aside())
        inside = head + "".join(parts)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            inside = self.wrap("plain", inside, tag="div")
        return self.wrap("article", inside, 1)

    def page(self) -> str:
        parts = [self.article()]
        if self.chance(0.3):
            parts.append(self.comments())
        if self.chance(0.4):
            parts.insert(self.rng.choice([0, len(parts)]), self.sidebar())
        if self.chance(0.25):
            parts.insert(self.rng.randint(0, len(parts)), self.aside())
        if self.chance(0.5):
            parts = [self.wrap("plain", "".join(parts), tag="div")]
        for p, make in ((0.4, self.advert), (0.7, self.menu), (0.5, self.header), (0.15, self.notice), (0.1, self.form)):
            if self.chance(p):
                parts.insert(0, make())
        for p, make in ((0.15, self.sidebar), (0.15, self.advert), (0.12, self.form), (0.75, self.footer), (0.15, self.notice)):
            if self.chance(p):
                parts.append(make())
        body = "".join(parts)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            body = self.wrap("plain", body, tag="div")
        title = self.text(self.story[0][:60]) if self.chance(0.8) else self.phrase("header")
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>"


def made_up(prose: list[list[str]], n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [Layout(rng, prose).page() for _ in range(n)]

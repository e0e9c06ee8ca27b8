"""Labelled pages that the extraction model is trained on.

Small pages of several layouts. An element with `data-main` is content, one with `data-not` is
not, and what stands inside takes the label of the nearest such element; the body is not content.
"""

#: Parts of pages that are not content.
ASIDES = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>',
    '<div class="nav main-menu"><a href="/x">News</a> <a href="/y">Sport</a></div>',
    '<div class="menu"><ul class="menu-list"><li class="menu-item"><a href="/x">News</a></li></ul></div>',
    '<div id="navigation" role="navigation"><p><a href="/x">Start</a></p></div>',
    '<ul class="breadcrumb breadcrumbs"><li><a href="/">Home</a></li><li>Here</li></ul>',
    '<header><h2>The Daily Site</h2><p>Your news every day.</p></header>',
    '<div class="header site-header masthead" role="banner"><div class="logo">The Site</div><p>A fine site for all.</p></div>',
    '<footer><p>Copyright 2020 by the site. All rights reserved.</p><a href="/imprint">Imprint</a></footer>',
    '<div class="footer" id="footer" role="contentinfo"><p>All rights reserved, no text may be copied.</p></div>',
    '<aside><h3>Most read</h3><ul><li><a href="/1">A first story</a></li><li><a href="/2">A second story</a></li></ul><p>Weather today is fine.</p></aside>',
    '<div class="sidebar side widget" id="sidebar" role="complementary"><h3>Archive</h3><p>All the months of the year.</p><ul><li><a href="/2">May</a></li></ul></div>',
    '<div class="ad">Buy the best things here, they are cheap and good.</div>',
    '<div class="ads advert advertisement sponsored promo"><p>Only today, two for one. Buy it now!</p></div>',
    '<section class="ad banner"><h4>Great offer</h4><p>A long text that praises a thing, and then praises it more, and asks you to buy it.</p></section>',
    '<div class="cookie cookies notice consent gdpr" id="cookie-notice" role="alert"><p>We use cookies to make this site better. By reading on you agree.</p><button>Accept</button></div>',
    '<div class="notice alert popup modal overlay" role="dialog"><p>Please switch on scripts to see all of this page.</p></div>',
    '<form action="/s" class="search-form"><label>Search</label><input name="q"><button>Go</button><select><option>All</option><option>News</option></select></form>',
    '<div class="newsletter subscribe signup"><p>Get our letter each week, free of charge.</p><form><input name="mail"><button>Send</button></form></div>',
    '<div class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>I liked this text very much, thank you for writing it.</p></div><div class="comment reply"><p>So did I.</p></div></div>',
    '<section class="comment-list responses replies discussion"><article class="comment"><p>A reader says that all of this is wrong, and gives many reasons for it.</p></article></section>',
    '<ol class="commentlist"><li class="comment"><p>First!</p></li></ol>',
    '<div class="share social sharing"><a href="/f">Share</a> <a href="/t">Send</a></div>',
    '<div class="related recommended more"><h3>Related</h3><ul><li><a href="/1">Another text</a></li><li><a href="/2">One more</a></li></ul></div>',
    '<div class="pagination pager"><a href="/2">2</a> <a href="/3">next</a></div>',
    '<div class="login user" id="login"><p>Sign in or register.</p></div>',
    '<noscript><p>This page needs scripts.</p></noscript>', '<template><p>Not shown.</p></template>', '<div hidden><p>Not shown now.</p></div>',
    '<iframe>No frames.</iframe>', '<button>Print this</button>', '<dialog><p>Are you sure?</p></dialog>',
)
_BODY = ("<h1>A headline of the page</h1><p>A first long text that tells what has happened, where it was and who took part in it, with commas.</p><p>Short one.</p>"
         "<h2>A part</h2><p>Another text with a <a href='/l'>link</a> in it, that goes on for a while.</p><ul><li>one point of it</li><li>and one more</li></ul>"
         "<blockquote><p>Words that were said.</p></blockquote><pre>some code</pre><table><tr><th>a</th><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
         "<figure><figcaption>What is seen here.</figcaption></figure><dl><dt>term</dt><dd>its meaning</dd></dl><section><h3>More</h3><p>A last text.</p></section><div><p>In a box.</p></div>")
_PLAIN = "<h1>Title</h1><p>Only a line.</p><p>And then a second text, which is a little longer than the first one was.</p>"
#: Parts that are content.
MAINS = (
    f"<article data-main>{_BODY}</article>", f"<article data-main>{_PLAIN}</article>", f"<article data-main class='post entry'>{_BODY}</article>",
    f"<main data-main><article>{_BODY}</article></main>", f"<main data-main role='main'>{_PLAIN}</main>", f"<main data-main>{_BODY}</main>",
    f"<div data-main class='content article-body post-content entry-content story' id='content'>{_BODY}</div>",
    f"<div data-main id='main-content' class='text article'>{_PLAIN}</div>", f"<section data-main class='article story'>{_BODY}</section>",
    f"<div class='page wrapper container' id='page'><div class='row'><article data-main>{_BODY}</article></div></div>",
    "<main data-main><h1>Title</h1><p>Only a line.</p></main>", "<article data-main><p>Only a line.</p></article>", "<article data-main><h1>Title</h1><p>A line.</p></article>",
    "<h1 data-main>A headline of it</h1><p data-main>A text without any frame around it, that is long enough to be read.</p><p data-main>Short one.</p>",
    "<div><p data-main>A text in a plain box, that tells of many things, and then of more.</p><p data-main>And a second.</p></div>",
    "<article data-main><header data-main><h1>The headline</h1></header><p>Text of the page, which is not long.</p></article>",
)


#: Names that frames of other parts bear, and names of frames of content.
ASIDE_NAMES = ("nav navbar menu submenu breadcrumb header masthead topbar footer bottom copyright sidebar side widget cookie cookies consent gdpr notice notification alert "
               "warning popup modal overlay ad ads adv advert advertisement sponsored sponsor promo promotion banner comment comments reply replies responses discussion disqus "
               "form search newsletter subscribe signup login share sharing social related recommended more pagination pager toolbar "
               "kommentar kommentare anzeige werbung fusszeile kopfzeile seitenleiste hinweis commentaire commentaires publicite annonce pied entete "
               "comentario comentarios publicidad anuncio pie cabecera barra aviso").split()
#: Lists of links in frames without a name.
LINKS = ("<a href='/1'>Home</a> <a href='/2'>About us</a> <a href='/3'>Contact</a>", "<a href='/1'>A first story</a><br><a href='/2'>A second story</a>",
         "<ul><li><a href='/a'>News</a></li><li><a href='/b'>Sport and games</a></li><li><a href='/c'>All of it</a></li></ul>")
MAIN_NAMES = "content article story post entry text main".split()
_SAID = "A text that is as long as others are, with commas, and that ends in the way of a sentence."


def _asides() -> list[str]:
    kinds = ("<div class='{0}'><p>{1}</p></div>", "<section id='{0}'><h2>Some words</h2><p>{1}</p><p>And so on.</p></section>", "<div class='{0}-box'>{1}</div>")
    tags = [f"<{t}>{inner}</{t}>" for t in ("nav", "header", "footer", "aside", "form", "dialog", "noscript", "button") for inner in (_SAID, f"<p>{_SAID}</p>", "Few words")]
    frames = ("<div>{0}</div>", "<div class='{1}'>{0}</div>", "<table><tr><td>{0}</td></tr></table>", "<section id='{1}'>{0}</section>")
    unnamed = [f.format(inner, f"x{k}q") for k, inner in enumerate(LINKS * 3) for f in frames]
    return [*ASIDES, *tags, *[k.format(name, _SAID) for name in ASIDE_NAMES for k in kinds], *unnamed]


def _mains() -> list[str]:
    # Content of pages whose frames say nothing, or that have none.
    texts = [_BODY, _PLAIN, f"<p>{_SAID}</p><p>{_SAID} {_SAID}</p>", f"<p>{_SAID}</p>", "<h2>Some words</h2><p>Only a line.</p><p>And one more.</p>"]
    framed = [f.format(t) for t in texts for f in ("<div data-main>{0}</div>", "<div data-main class='xq1'>{0}</div>", "<div id='q7'><div data-main class='zz'>{0}</div></div>",
                                                   "<table data-main><tr><td>{0}</td></tr></table>")]
    loose = 3 * [t.replace("<p>", "<p data-main>").replace("<h1>", "<h1 data-main>").replace("<h2>", "<h2 data-main>") for t in texts[1:]]
    return [*MAINS, *[f"<div data-main class='{n}'>{body}</div>" for n in MAIN_NAMES for body in (_BODY, f"<p>{_SAID}</p>")], *framed, *loose]


def labelled_pages() -> list[str]:
    """Each other part with some content parts, before or after them, and inside them where they
    have a frame: at the start, in the middle or at the end."""
    pages, asides, mains = [], _asides(), _mains()
    for i, aside in enumerate(asides):
        others = [asides[(i * 7 + 31 * k) % len(asides)] for k in (1, 2, 3)]
        for k in range(4):
            main = mains[(i * 4 + k) % len(mains)]
            if k and main.startswith(("<article", "<main data", "<div data", "<section")):
                spots = sorted({main.index(">") + 1, main.find("</p>") + 4, main.rindex("</")} - {(i + k) % 3 and main.index(">") + 1})
                for n, at in enumerate(reversed(spots[-k:])):
                    part = (aside, others[0], others[1])[n].replace(">", " data-not>", 1)
                    main = main[:at] + part + main[at:]
                body = (others[0] + main, main + others[0])[i % 2]
            else:
                body = (aside + main, main + aside)[i % 2] + others[0]
            pages.append(f"<html><head><title>A title</title><style>p{{}}</style></head><body>{others[1]}{body}{others[2]}</body></html>")
    alone = [f"<html><body>{main}</body></html>" for main in mains]
    forms = [m.replace("</p>", f"</p><form data-not>{inner}</form>", 1) for m in mains if not m.startswith(("<p", "<h")) for inner in ("<p>Mail</p>", f"<p>{_SAID}</p><button>Send</button>")]
    short = "They said so."
    named = [f"<article data-main>{m}<{t} data-not class='{n}'>{inner}</{t}></article>" for n in ASIDE_NAMES for m, t, inner in (
        (f"<p>{short}</p>", "section", f"<p>{short}</p>"), (_PLAIN, "div", f"<p>{_SAID}</p>"), (f"<section><h3>More</h3><p>{short}</p></section>", "section", f"<h3>More</h3><p>{_SAID}</p>"))]
    cells = [f"<table><tr>{row}</tr></table>" for links in LINKS for text in (f"<p>{_SAID}</p><p>{short}</p>", _PLAIN, _BODY) for row in (
        f"<td data-not>{links}</td><td data-main>{text}</td>", f"<td data-main>{text}</td><td data-not>{links}</td>")]
    return [*pages, *alone, *forms, *named, *cells, *cells]

"""Labelled pages of layouts that carry no landmark elements, for the extraction model.

Each is a page with a ``data-y="1"`` attribute on the elements that hold main text.
``[P]``, ``[S]`` and ``[W]`` stand for a paragraph, a short sentence and a menu word of the
pages at hand, ``(... )*`` for a part that repeats.  Written by hand for this library.
"""

from __future__ import annotations

import random
import re

LAYOUTS = (
    '<body><div id="header" class="{header}"><a href="/">[W]</a><p>[S]</p></div><div class="{nav}"><ul>(<li><a href="#">[W]</a></li>)*</ul></div>'
    '<div id="content" class="{text}"><h1 data-y="1">[S]</h1>(<p data-y="1">[P]</p>)*</div>'
    '<div class="{side}"><h3>[W]</h3><ul>(<li><a href="#">[S]</a></li>)*</ul><p>[P]</p></div><div id="footer" class="{footer}">&copy; [S]</div></body>',
    '<body><div class="{notice}"><p>We use cookies. [S]</p><button>Accept</button></div><div class="{nav}"><a href="#">[W]</a> | <a href="#">[W]</a></div>'
    '<div class="post"><h2 class="post-title" data-y="1">[S]</h2><div class="{text}" data-y="1">(<p>[P]</p>)*<blockquote>[P]</blockquote>(<p>[P]</p>)*</div>'
    '<div class="{share}">Share this: <a href="#">[W]</a> <a href="#">[W]</a></div></div>'
    '<div id="comments" class="{comments}"><h3>Comments</h3>(<div class="comment"><span class="author">[W]</span><p>[P]</p><a href="#">Reply</a></div>)*'
    '<form class="comment-form"><label>[W]</label><p>[S]</p><textarea>[S]</textarea></form></div><div class="{footer}">All rights reserved</div></body>',
    '<body><header class="{header}"><h1>[W]</h1><p class="tagline">[S]</p></header><nav><a href="#">[W]</a> <a href="#">[W]</a></nav>'
    '<section class="story" data-y="1"><h1>[S]</h1>(<p>[P]</p>)*<h2>[S]</h2>(<p>[P]</p>)*<ul><li>[S]</li><li>[P]</li></ul></section>'
    '<aside class="{side}"><h4>Related</h4>(<p><a href="#">[S]</a></p>)*</aside><div class="newsletter"><form><p>Subscribe to our newsletter. [S]</p><input></form></div>'
    '<footer><p>[S]</p><p>Copyright</p></footer></body>',
    '<body><table><tr><td class="{nav}"><a href="#">[W]</a><br><a href="#">[W]</a><br><a href="#">[W]</a></td>'
    '<td class="maincol"><h1 data-y="1">[S]</h1><p data-y="1">[P]</p><div class="{ad}">[S]</div>(<p data-y="1">[P]</p>)*</td><td class="{side}"><p>[S]</p></td></tr></table>'
    '<p class="{footer}">&copy; [S] Privacy policy</p></body>',
    '<body><div class="breadcrumb"><a href="#">[W]</a> &gt; <a href="#">[W]</a></div><main data-y="1"><h1>[S]</h1>(<p>[P]</p>)*</main>'
    '<section class="{comments}"><h2>[S]</h2>(<article class="comment"><p>[P]</p></article>)*</section>'
    '<div class="{ad}"><p>[P]</p></div><div class="login"><form><label>Sign in</label><p>[S]</p></form></div></body>',
    '<body><div role="banner"><p>[S]</p></div><div role="navigation"><ul>(<li><a href="#">[W]</a></li>)*</ul></div>'
    '<article><h1 data-y="1">[S]</h1>(<p data-y="1">[P]</p>)*<div class="{notice}"><p>[S]</p></div>(<p data-y="1">[P]</p>)*<aside><h3>[S]</h3><p>[P]</p></aside>'
    '<div class="{ad}"><p>[P]</p></div><p data-y="1">[P]</p><footer>[S]</footer></article><div role="contentinfo"><p>[S]</p></div></body>',
    '<body><div class="{notice}"><p>[P]</p></div><div class="article-body" itemprop="articleBody" data-y="1"><p>[P]</p><pre>[P]</pre><table><tr><td>[S]</td><td>[S]</td></tr></table><p>[P]</p></div>'
    '<div class="{comments}"><ol class="commentlist">(<li class="comment"><p>[P]</p></li>)*</ol></div><div class="{side}"><ul>(<li><a href="#">[S]</a></li>)*</ul></div></body>',
    '<body><div class="{header}">[W] [W]</div>(<div data-y="1">[P]</div>)*<div class="pagination"><a href="#">[W]</a> <a href="#">[W]</a></div><div class="disclaimer">[S]</div></body>',
    '<body><article class="teaser"><h3><a href="#">[S]</a></h3><p><a href="#">[S]</a></p></article><div class="{text}" data-y="1"><h1>[S]</h1>(<p>[P]</p>)*<dl><dt>[W]</dt><dd>[P]</dd></dl></div>'
    '<form action="/search" class="search"><p>[S]</p><select><option>[W]</option></select></form><form><fieldset><legend>[W]</legend><p>[P]</p><label>[W]</label></fieldset></form></body>',
    '<body><header><a href="/">[W]</a><p>[S]</p></header><article><header data-y="1"><h1>[S]</h1></header><div class="{ad}">[S]</div>(<p data-y="1">[P]</p>)*<div class="{comments}"><p>[P]</p></div><footer>[W] [S]</footer></article>'
    '<div class="{side}"><p>[P]</p></div><div class="{notice}"><p>[P]</p></div></body>',
    '<body><article><header data-y="1"><h1>[S]</h1></header><div class="{ad}">[S]</div>(<p data-y="1">[P]</p>)*</article><nav><a href="#">[W]</a> <a href="#">[W]</a></nav><footer>[S]</footer></body>',
    '<body><aside><p>[P]</p></aside><main><h1 data-y="1">[S]</h1><p data-y="1">[P]</p><section class="{ad}"><p>[P]</p></section>(<p data-y="1">[P]</p>)*<form><p>[P]</p><button>[W]</button></form></main><aside class="{ad}">[S]</aside></body>',
)
# words for the classes of a layout: a name in braces is one or two of its words
CLASSES = {
    "ad": "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner",
    "comments": "comments comment-list reader-comments responses replies discussion feedback comment",
    "footer": "footer site-footer bottom copyright legal colophon footnav",
    "header": "header masthead site-header top topbar page-header branding",
    "nav": "nav navbar menu navigation main-menu links toc breadcrumb",
    "notice": "notice alert cookie-notice cookie-banner message warning notification consent gdpr popup modal",
    "share": "share social sharing follow tools share-buttons",
    "side": "sidebar side related widget archive recent popular more-stories recommended rail",
    "text": "content entry-content post-content article-text text body-text story-body article main-content page",
}
REPEATED = re.compile(r"\((.*?)\)\*")
SLOT = re.compile(r"\[([PSW])\]")
CLASS = re.compile(r"\{(\w+)\}")


def labelled_pages(n: int, texts: dict[str, list[str]], seed: int) -> list[str]:
    """``n`` pages over the layouts in turn; ``texts`` has escaped texts for P, S and W."""
    draw = random.Random(seed)
    pages = []
    for i in range(n):
        page = REPEATED.sub(lambda m: m[1] * draw.randint(1, 6), LAYOUTS[i % len(LAYOUTS)])
        page = CLASS.sub(lambda m: " ".join(draw.sample(CLASSES[m[1]].split(), draw.randint(1, 2))), page)
        pages.append(SLOT.sub(lambda m: draw.choice(texts[m[1]]), page))
    return pages

"""A few labelled pages from which the extraction model is taught what the given pages do not show.

`data-main="1"` begins the main text and `data-main="0"` what is none inside it; the label holds for everything below until
another one.  Texts are neutral filler: the model sees lengths, links, tags and names of classes, hardly any words.
"""

from __future__ import annotations

P = "The council met on Tuesday to discuss the plan, and after two hours it had agreed on most of its points. Members said that work would begin in spring."
Q = "Prices rose by a little over three per cent in the year to March, the office said. Analysts had expected less, and some of them spoke of a surprise."
R = "I do not agree with this at all. My family has lived here for thirty years and nobody ever asked us what we think about it, which is a shame."
S = "A short line."
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "Culture", "Contact"))
COOKIES = "We use cookies to improve this site. By going on you accept our use of cookies and our privacy policy."


def paragraphs(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


LABELLED = [
    # a news page with everything around it
    f'<html><body><div class="cookie-banner"><p>{COOKIES}</p><button>OK</button></div><header class="site-header"><div class="logo"><a href="/">The Paper</a></div><nav><ul>{LINKS}</ul></nav></header><main><article data-main="1"><header><h1>Council agrees</h1><p class="byline">By A Writer</p></header>{paragraphs(P, Q, S, P)}<div class="ad" data-main="0">Advertisement. Buy two, get one.</div><h2>What is next</h2>{paragraphs(Q, P)}<blockquote>{paragraphs(S)}</blockquote><ul><li>One point of the plan.</li><li>Another point.</li></ul></article><section id="comments"><h2>3 Comments</h2><div class="comment"><p>{R}</p></div><div class="comment"><p>{R} {R}</p></div><form><label>Name</label><input><p>Leave a reply</p></form></section></main><aside class="sidebar"><h3>Most read</h3><ul>{LINKS}</ul><p>{Q}</p></aside><footer><p>&copy; The Paper. All rights reserved.</p><ul>{LINKS}</ul></footer></body></html>',
    # classes only
    f'<body><div id="header"><div id="logo">A Blog</div><div class="menu"><ul>{LINKS}</ul></div></div><div id="wrapper"><div id="content" data-main="1"><div class="post"><h1>On plans</h1><div class="entry-content">{paragraphs(P, P, Q)}<p>{S}</p></div></div><div class="post-comments" data-main="0"><h3>Comments</h3><ol><li class="comment-body">{paragraphs(R, R)}</li><li class="comment-body">{paragraphs(R)}</li></ol></div></div><div id="sidebar"><div class="widget"><h3>About</h3><p>{Q}</p></div><div class="widget"><ul>{LINKS}</ul></div></div></div><div id="footer">Copyright A Blog</div></body>',
    # tables for layout, no classes
    f'<body><table><tr><td><a href="/1">Home</a> <a href="/2">News</a> <a href="/3">Links</a></td></tr><tr><td><div data-main="1"><h1>An old page</h1>{paragraphs(P, Q, P)}</div></td></tr><tr><td>Copyright 1999</td></tr></table></body>',
    # text straight in a div
    f'<body><div class="top-bar"><a href="/">Start</a> | <a href="/a">Archive</a></div><div class="article-body" data-main="1"><h1>Lines</h1>{P}<br>{Q}<div>{P}</div></div><div class="related-posts"><h4>Read more</h4><ul>{LINKS}</ul></div><div class="share-buttons"><a href="/s">Share</a></div></body>',
    # a page wrapped in a form
    f'<body><form id="page"><div class="navigation"><ul>{LINKS}</ul></div><div class="main" data-main="1"><h1>Rules</h1>{paragraphs(Q, P, Q, S)}<table><tr><th>Year</th><th>Price</th></tr><tr><td>2001</td><td>14</td></tr></table></div><div class="bottom">{paragraphs("Imprint. Terms of use.")}</div></form></body>',
    # comments inside the article, notices, newsletter, login
    f'<body><div role="banner"><p>Big site</p></div><div role="navigation"><ul>{LINKS}</ul></div><div class="notice"><p>{Q}</p></div><article data-main="1"><h1>Prices</h1>{paragraphs(Q, P)}<aside class="pull" data-main="0"><p>{S}</p></aside>{paragraphs(P)}<figure><img><figcaption>The market in March.</figcaption></figure>{paragraphs(Q)}<footer data-main="0"><p>Filed under: <a href="/x">Prices</a></p></footer><div class="comments-area" data-main="0"><div class="comment-content">{paragraphs(R, P, R)}</div></div></article><div class="newsletter-signup"><p>Sign up for our newsletter and never miss a story. {S}</p><form><input></form></div><div class="login-form"><form><p>{S} Log in to go on.</p></form></div><div role="contentinfo"><p>{Q}</p></div></body>',
    # short article, long surroundings
    f'<body><nav class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></nav><main data-main="1"><h1>Closed</h1><p>{S}</p></main><div class="sponsored-content"><h2>Sponsored</h2>{paragraphs(P, Q)}</div><div id="disqus_thread">{paragraphs(R, R, R)}</div><div class="modal popup">{paragraphs(COOKIES)}</div><footer class="page-footer">{paragraphs(Q)}</footer></body>',
    # sections inside, teasers after
    f'<body><div class="masthead"><h2>Magazine</h2></div><div class="story" data-main="1"><h1>Long read</h1><section><h2>First</h2>{paragraphs(P, Q)}</section><section><h2>Second</h2>{paragraphs(Q, S, P)}<pre>code = 1</pre></section></div><div class="recommended"><div class="teaser"><h3><a href="/t">Another story</a></h3><p>{Q}</p></div><div class="teaser"><h3><a href="/u">A third</a></h3><p>{P}</p></div></div><div class="alert">{paragraphs(S)}</div></body>',
    # bare
    f'<h1 data-main="1">Just text</h1><p data-main="1">{P}</p><p data-main="1">{Q}</p><p data-main="1">{S}</p>',
    f'<body><header><h1>Site of sites</h1><p>{S}</p><form class="search"><p>Search this site</p></form></header><div class="page"><div class="text" data-main="1"><h1>Notes</h1>{paragraphs(S, P)}<dl><dt>Term</dt><dd>{S}</dd></dl>{paragraphs(Q)}</div></div><div class="advert">{paragraphs(P)}</div><section class="reader-comments"><article class="comment"><h4>Reader</h4>{paragraphs(R)}</article><article class="comment">{paragraphs(R)}</article></section></body>',
    # an article of a paragraph or two
    f'<body><article data-main="1"><header><h1>Brief</h1></header><p>{Q}</p><aside data-main="0"><p>{P}</p></aside><p>{P}</p><div class="comments" data-main="0"><p>{R}</p></div></article></body>',
    f'<body><nav><a href="/">Home</a></nav><div class="ad">{Q}</div><article data-main="1"><h1>Briefer</h1><p>{S} {S}</p></article><aside>{P}</aside><footer>{Q}</footer></body>',
    f'<body><header><a href="/">Home</a></header><main data-main="1"><article><h2>Brief again</h2><p>{P}</p><p>{S}</p></article></main><div class="comment-list"><article><p>{P}</p></article><article><p>{R}</p></article></div></body>',
]

"""A small set of labelled pages for the decision tree of `html_text`. [n] stands for n words; a block that begins with ¶ is main text.
Each page has another layout: with and without article elements, layout classes that name what they don't hold, forms around everything."""

PAGES = (
    # news: article element, everything else by element
    "<nav><ul><li><a>[1]</a><li><a>[1]</a><li><a>[2]</a></ul></nav><div class=ad>[9]</div><article><h1>¶[8]</h1><p>¶[3]</p><p>¶[45]</p><p>¶[60]</p><p>¶[4]</p><h2>¶[3]</h2><p>¶[30] <a>[4]</a></p></article><footer>[9]</footer>",
    "<header><a>[2]</a><a>[1]</a></header><main><h1>¶[5]</h1><p>¶[1]</p><p>¶[90]</p><ul><li>¶[4]<li>¶[2]<li>¶<a>[3]</a></ul><div class=share-buttons><a>[1]</a> <a>[1]</a></div><p>¶[55]</p><aside><h3>[2]</h3><p>[20]</p></aside></main><footer><p>[12]</p><a>[2]</a></footer>",
    "<body class=no-sidebar><div class='site has-comments'><article><p>¶[2]</p><p>¶[12]</p><div class=promo>[15]</div><p>¶[70] <a>[2]</a></p><section class=comments><p>[18]</p><p>[40]</p></section></article></div><div class=sidebar><p>[30]</p><a>[4]</a></div>",
    "<div class=cookie-banner>[25] <a>[1]</a></div><nav><a>[1]</a><a>[1]</a></nav><article><header><h1>¶[9]</h1><p>¶[4]</p></header><p>¶[35]</p><blockquote>¶[12]</blockquote><p>¶[28]</p><div class=related><h4>[2]</h4><a>[7]</a><a>[8]</a></div></article>",
    # blogs without article elements: blocks alone tell
    "<div id=menu><a>[1]</a> <a>[1]</a> <a>[2]</a></div><div id=content><h1>¶[7]</h1><p>¶[50]</p><p>¶[80] <a>[3]</a></p><p>¶[6]</p><p>¶[44]</p></div><div id=links><a>[3]</a> <a>[2]</a> <a>[4]</a></div><div>[5]</div>",
    "<div><a>[1]</a> <a>[2]</a></div><div><a>[2]</a></div><table><tr><td><a>[2]</a><br><a>[1]</a></td><td><h2>¶[6]</h2>¶[40]<p>¶[65]</p><p>¶[18]</p><p>¶[33]</p></td></tr></table><div><a>[2]</a> <a>[1]</a> <a>[2]</a></div>",
    "<form action=x><div class=top><a>[1]</a> <a>[1]</a></div><div class=body><h1>¶[5]</h1><p>¶[38]</p><p>¶[72]</p><p>¶[25] <a>[2]</a></p></div><div>[3] <a>[2]</a></div></form>",
    "<div class='layout with-sidebar'><div class=post-body><p>¶[30]</p><p>¶[9]</p><p>¶[41]</p></div></div><div class=sidebar><h3>[2]</h3><p>[24]</p><a>[3]</a></div><div class=comments-area><p>[22]</p><p>[35]</p></div><div class=footer>[8] <a>[1]</a></div>",
    "<div class=overflow-hidden><h1>¶[4]</h1><p>¶[27]</p><p>¶[48]</p></div><div class=newsletter-signup>[14]<form><button>[2]</button></form></div><div class=pager><a>[1]</a> <a>[1]</a></div>",
    "<p><a>[2]</a> <a>[2]</a> <a>[1]</a></p><h1>¶[6]</h1><p>¶[22]</p><p>¶[95]</p><p>¶[40] <a>[6]</a></p><hr><p>[4] <a>[2]</a></p>",
    "<div class=breadcrumb><a>[1]</a> <a>[1]</a> [2]</div><h2>¶[7]</h2><div>¶[52]</div><div>¶[36]</div><div class=advert>[30]</div><div>¶[61]</div><div class=tags><a>[1]</a> <a>[1]</a></div>",
    # forms inside, lists of links, short pages
    "<nav>[1] <a>[1]</a></nav><div><h1>¶[5]</h1><p>¶[33]</p></div><form><label>[2]</label><p>[6]</p><button>[1]</button></form><div><a>[4]</a></div><div><a>[5]</a></div><div><a>[3]</a></div>",
    "<div><a>[2]</a></div><div><a>[1]</a></div><div><a>[3]</a></div><div>[2]</div><div><a>[2]</a></div><div>[3] <a>[3]</a></div><footer>[6]</footer>",
    "<article><p>¶[1]</p></article><footer>[4]</footer>",
    "<nav><a>[2]</a></nav><article><p>¶[6]</p></article><div class=notice>[11]</div>",
    "<main><div class=alert>[16]</div><p>¶[20]</p><p>¶<a>[6]</a></p><p>¶[58]</p></main><div>[10] <a>[9]</a></div>",
    "<article><h1>¶[6]</h1><div class=subscribe>[12]</div><p>¶[14] <a>[9]</a></p><ul><li>¶<a>[2]</a><li>¶<a>[4]</a></ul><p>¶[3]</p><nav><a>[2]</a></nav></article>",
    "<div class=hero><h1>¶[6]</h1><p>¶[19]</p></div><div class=text><p>¶[70]</p><h3>¶[3]</h3><p>¶[46]</p></div><div class=social><a>[1]</a> <a>[1]</a></div><div><h4>[2]</h4><div><a>[6]</a></div><div><a>[7]</a></div></div>",
    "<div>[3]</div><div>[2] <a>[1]</a></div><div><p>¶[85]</p><p>¶[64]</p></div><div>[4]</div>",
    "<article><p>¶[24]</p><dl><dt>¶[1]<dd>¶[7]<dt>¶[2]<dd>¶[12]</dl><pre>¶[15]</pre><figure><figcaption>¶[9]</figcaption></figure><p>¶[2]</p></article><aside><p>[50]</p></aside><div class=disqus><p>[60]</p></div>",
    "<div class='content social-wrap'><h1>¶[6]</h1><p>¶[40]</p><p>¶[70]</p><p>¶[31]</p></div><div class=social-bar><a>[1]</a> <a>[1]</a> [2]</div>",
    "<p>[30]</p><article><h1>¶[7]</h1><p>¶[66]</p><p>¶[21]</p></article><p>[44]</p><div class=teaser>[26]</div>",
    "<div><a>[1]</a></div><div class='search-results'><p>¶[60]</p><p>¶[55]</p></div><div class=search-box>[2]</div>",
    "<article><p>¶[50]</p><form><label>[1]</label><button>[1]</button></form><p>¶[1]</p><p>¶[20]</p></article>",
    "<main><p>¶[9]</p><ul><li>¶[2]<li>¶[2]</ul><form><p>[8]</p><label>[1]</label><button>[1]</button></form><p>¶[1]</p></main>",
    "<article><ul><li>¶[2]<li>¶[1]</ul><form>[2]<button>[1]</button></form><div class=ad-box>[2]</div><p>¶[1]</p><p>¶[2]</p></article>",
    # pages of little else than their text
    "<article><h1>¶[5]</h1><p>¶[21]</p><p>¶[21]</p></article>",
    "<main><p>¶[60]</p><p>¶[12]</p></main>",
    "<article><p>¶[3]</p><p>¶[2]</p><p>¶[5]</p></article>",
    "<main><article><p>¶[22]</p><p>¶[22]</p></article></main>",
    "<h1>¶[4]</h1><p>¶[30]</p><p>¶[22]</p>",
    "<div><p>¶[22]</p><p>¶[22]</p></div>",
    "<article><h1>¶[2]</h1><p>¶[5] <a>[2]</a></p><p>¶[3]</p><p>¶[2]</p><ul><li>¶[2]<li>¶[2]</ul><p>¶[1]</p></article>",
    "<article><h1>¶[3]</h1><p>¶[7]</p><p>¶<a>[1]</a></p><p>¶[1]</p><p>¶[44] <a>[2]</a></p><p>¶[6]</p></article>",
    "<nav><a>[1]</a></nav><article><p>¶[20]</p><p>¶[3]</p></article>",
    "<div><a>[1]</a></div><div><a>[2]</a></div><div><p>¶[33]</p><p>¶[18]</p></div>",
    "<div><a>[2]</a></div><p>¶[28]</p><p>¶[50]</p><p>[3]</p>",
    "<form><p>¶[22]</p><p>¶[31]</p></form>",
    "<h1>¶[5]</h1><p>¶[55]</p><p>¶[26]</p><div>[6] <a>[1]</a></div>",
    "<h2>¶[3]</h2><p>¶[75]</p><p>¶[40] <a>[2]</a></p><div>[8] <a>[1]</a></div>",
    # articles of short blocks and links
    "<article><p>¶[2]</p><p>¶[30]</p><p>¶<a>[4]</a></p><p>¶[1]</p><p>¶[3]</p><p>¶<a>[2]</a></p><p>¶[2]</p><p>¶[14]</p><p>¶<a>[5]</a></p></article>",
    "<main><ul><li>¶<a>[1]</a><li>¶[2]<li>¶<a>[2]</a><li>¶[5]<li>¶<a>[3]</a></ul><p>¶[2]</p><p>¶[60]</p><p>¶<a>[6]</a></p></main><footer><a>[2]</a></footer>",
    "<article><h1>¶[1]</h1><p>¶[9]</p><p>¶<a>[2]</a> <a>[1]</a></p><h2>¶[2]</h2><p>¶[17]</p><p>¶<a>[3]</a></p><p>¶[1]</p></article>",
)

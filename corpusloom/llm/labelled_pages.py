"""Labelled pages from which the extractor's weights are learned. Elements marked data-main hold main text, but not what is marked data-out in them."""

#: One page a line; written for this purpose. W stands for some words.
PAGES = """
<html><head><title>W</title></head><body><header class="site-header"><a>W</a><nav class="menu"><ul><li><a>W</a></li><li><a>W</a></li></ul></nav></header><div class="ad">W W</div><article data-main><h1>W W</h1><p>W W W W</p><p>W W <b>W</b> W</p><ul class="list"><li>W W</li><li>W</li></ul><ol><li>W</li></ol><h2>W</h2><h3>W</h3><h4>W</h4><div class="advert" data-out>W</div><p>W W W</p><aside data-out><p>W</p></aside><p>W</p></article><aside class="sidebar"><h3>W</h3><p>W W</p></aside><section class="comments"><h3>W</h3><div class="comment"><p>W W W</p></div><div class="comment"><p>W W</p></div></section><footer>W W</footer></body></html>
<html><body><div id="cookie-notice" class="notice banner"><p>W W W</p><button>W</button></div><nav role="navigation"><a>W</a><a>W</a></nav><main><div class="breadcrumbs"><a>W</a></div><div class="content" data-main><h2>W</h2><p>W W W W W</p><blockquote><p>W W</p></blockquote><p>W W W<br>W W</p><div class="ad" data-out><p>W</p></div><form class="newsletter" data-out><p>W</p></form><pre>W W</pre><table><tr><th>W</th><td>W W</td></tr></table></div><form class="newsletter"><p>W</p><label>W</label><input></form><div class="share social"><a>W</a></div><div class="related"><h3>W</h3><ul><li><a>W W</a></li></ul></div></main><footer class="site-footer"><p>W W</p></footer></body></html>
<html><body><div class="topbar"><a>W</a></div><div class="navbar menu"><ul><li><a>W</a></li></ul></div><div class="post" data-main><h1>W W</h1><h2>W</h2><h4>W</h4><ol class="list"><li>W W</li></ol><ul><li>W</li></ul><h5>W</h5><h6>W</h6><button data-out>W</button><div class="text"><p>W W W W</p></div><div class="text"><p>W W W</p><figure><figcaption>W W</figcaption></figure></div></div><div class="sidebar widget"><p>W W</p></div><div id="comments" class="comment-list"><ol><li class="comment"><p>W W W</p></li></ol><form class="comment-form"><p>W</p></form></div><div class="footer"><p>W</p></div></body></html>
<html><body><div class="banner promo"><p>W W</p></div><div class="advertisement sponsored"><p>W</p></div><section class="article-body" data-main><p>W W W W</p><div class="share" data-out><p>W</p></div><h3>W</h3><p>W W W</p><dl><dt>W</dt><dd>W W</dd></dl></section><aside class="related"><p>W W</p></aside><div class="ads"><p>W</p></div><div class="pagination pager"><a>W</a></div><div class="copyright legal"><p>W W</p></div></body></html>
<html><body><div class="cookie consent popup modal"><p>W W</p></div><header><h2>W</h2><p>W</p></header><menu><li>W</li></menu><article class="entry story" data-main><header><h1>W W</h1><p>W</p></header><section><h2>W</h2><p>W W W W W</p></section><section><p>W W W</p></section></article><div class="notice alert"><p>W W W</p></div><div class="replies discussion"><p>W W W W</p></div><form class="search login"><p>W</p></form><footer><p>W</p></footer></body></html>
<html><body><div class="header masthead"><p>W</p></div><div class="toolbar nav navigation"><a>W</a></div><div id="main" class="main content" data-main><p>W W W</p><p>W W W W</p><p>W</p></div><div class="advert sponsor promo"><p>W W</p></div><div class="subscribe newsletter signup"><p>W</p></div><div class="share"><p>W</p></div><div class="comments"><div class="comment reply"><p>W W</p></div></div><div class="footer"><p>W W</p></div></body></html>
<html><body><dialog><p>W W</p></dialog><nav class="breadcrumb"><a>W</a></nav><article data-main><h1>W</h1><p>W W W W</p><p>W <a>W W</a> W</p></article><article class="comment"><p>W W W</p></article><section id="comments" class="reader-comments"><p>W W</p></section><div class="widget sidebar"><h4>W</h4><p>W W</p></div><div class="disclaimer notice"><p>W W</p></div><footer><p>W</p></footer></body></html>
<html><body><div class="c1"><a>W</a> | <a>W</a> | <a>W</a> | <a>W</a></div><div class="c2" data-main><h1>W W W</h1><p>W W W W W W W W</p><p>W W W <a>W W</a> W W W W W</p><h2>W W W</h2><p>W W W W W W</p><h3>W W W</h3><p>W W <a>W W W</a> W W W</p></div><div class="c3"><a>W W</a><br><a>W W</a><br><a>W W W</a></div><div class="c4">W W W</div></body></html>
<html><body><table><tr><td><a>W</a><br><a>W</a><br><a>W</a></td><td data-main><h2>W W W</h2><p>W W W W W W W W W</p><h3>W W W W</h3><p>W W W W W</p><p>W W W W W W W</p></td><td><a>W W</a> <a>W</a></td></tr></table><div>W W</div></body></html>
<html><body><div class="row"><div class="col"><ul><li><a>W</a></li><li><a>W W</a></li><li><a>W</a></li></ul></div><div class="col" data-main><h2>W W</h2><p>W W W W W W W</p><ul><li>W W W W</li><li>W W W <a>W</a> W</li></ul><p>W W W W W W W W</p></div></div><div class="row"><span>W</span> <span>W W</span></div></body></html>
<html><body><div id="x1"><h3>W W</h3><div><a>W</a></div><div><a>W</a></div></div><div id="x2" data-main><div>W W W W W W W W W W W</div><h3>W W W</h3><div>W W W W W W <b>W</b> W W W</div><p>W W <a>W W W W</a> W W</p><h2>W W W</h2><div>W W W W W W W</div></div><div id="x3"><h3>W</h3><p><a>W W W</a></p><p><a>W W</a></p><p><a>W W W W</a></p></div></body></html>
<html><body><center><a>W</a> <a>W</a> <a>W</a></center><h1 data-main>W W W W</h1><div data-main><p>W W W W W W W W<p>W W W W W W<p>W W W W W W W W W</div><p><a>W</a> - <a>W</a></p><center>W W</center></body></html>
<html><body><ul><li><a>W</a></li><li><a>W</a></li></ul><section data-main><h1>W W</h1><p>W W W W W W W W W W</p><blockquote>W W W W W</blockquote><p>W W W W W W W</p></section><section><h2>W W</h2><ul><li><a>W W W</a></li><li><a>W W W W</a></li></ul></section><div>W W <a>W</a></div></body></html>
<html><body><div id="page" class="site wrapper"><header class="site-header"><p>W</p></header><div class="site-content container row"><article data-main><header class="entry-header"><h1>W W</h1><div class="byline meta">W W</div></header><div class="entry-content"><p>W W W W</p><div class="text-widget"><p>W W W</p></div><p>W W</p><div class="row"><div class="col"><p>W W W</p></div></div><div class="note box"><p>W W</p></div><div class="ad-slot sponsored" data-out><p>W</p></div><div class="related recommended" data-out><p>W W</p></div><div class="newsletter promo signup" data-out><p>W</p></div></div></article></div><div id="disqus_thread" class="responses"><p>W W W W</p></div><footer><p>W</p></footer></div></body></html>
<html><body><div class="layout has-sidebar page"><div class="primary column"><article data-main class="hentry"><h1>W</h1><div><p>W W W W W</p></div><div><p>W W W</p><table><tr><td>W W</td></tr></table></div><div class="share social" data-out><p>W</p></div><div class="comments" data-out><p>W W W</p></div></article></div><div class="secondary sidebar"><p>W W</p></div></div><div class="gdpr bar"><p>W W</p></div></body></html>
<html><body><form id="form" class="page"><div class="top"><a>W</a><a>W</a></div><div class="middle" data-main><h2>W W W</h2><p>W W W W W W W</p><p>W W W W W W</p></div><div class="bottom"><p>W W</p></div></form></body></html>
<html><body><div class="reader header-fixed social"><main data-main><h1>W W</h1><p>W W W W</p><div class="text"><p>W W W W</p></div><section class="widget"><p>W W W</p></section></main></div><div class="outbrain taboola"><p>W W W</p></div><div class="recommended trending popular"><p>W W W</p></div></body></html>
<html><body><main class="site-main"><article data-main class="post"><p>W W W</p><div class="body"><div class="legal-text"><p>W W W</p></div><p>W W W</p></div></article><div class="responses feedback opinions"><div><p>W W W W</p></div><div><p>W W W W</p></div></div><div class="outbrain sponsored-links"><p>W W</p></div></main></body></html>
<html><body><div class="container"><div class="row"><div class="post-body" data-main><div class="paragraph">W W W W W W</div><div class="paragraph">W W W W W</div><div class="advert" data-out>W W</div><div class="paragraph">W W W W</div></div><div class="sidebar"><div class="widget"><p>W W</p></div></div></div><div class="row"><div id="disqus_thread"><p>W W W</p></div></div><div class="gdpr consent privacy"><p>W W</p></div></div></body></html>
<html><body><section class="layout site"><div class="wrapper"><h1 data-main>W W W</h1><div class="story-text" data-main><p>W W W W W W</p><p>W W W W</p><figure><figcaption>W W</figcaption></figure><div class="pullquote"><p>W W</p></div></div><div class="opinions thread replies"><div class="reply"><p>W W</p></div><div class="reply"><p>W W</p></div></div></div><footer><p>W</p></footer></section></body></html>
""".replace("W", "word").strip().split("\n")

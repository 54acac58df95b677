"""Pages written by hand, with their main text."""

PAGES = [
    # a news page without article, main or headings of use
    (
        """<!DOCTYPE html><html lang="en"><head><title>Harbour bridge closed | The Daily Post</title><meta charset=utf-8><style>.x{color:red}</style></head><body>
<div id="top"><div class="logo"><a href="/">The Daily Post</a></div><ul class="nav-list"><li><a href="/w">World</a><li><a href="/l">Local</a><li><a href="/s">Sport</a></ul></div>
<div class="wrap"><div class="col-left"><h1>Harbour bridge closed for six weeks</h1><p>The old harbour bridge will be closed to all traffic from Monday, the city council said yesterday.</p>
<p>Engineers found cracks in two of the four pillars. &ldquo;Nobody was ever in danger,&rdquo; said the head of the works department, &ldquo;but we will not wait until somebody is.&rdquo;</p>
<div class="advert"><span>Advertisement</span><a href="http://ads.example/1">Cheap flights to the sun from 29 euros</a></div>
<p>Buses will take the northern bridge. The ferry, which last ran in 1987, is to carry walkers and cyclists free of charge.</p>
<p>Work is expected to cost about four million euros, of which the state pays half.</p></div>
<div class="col-right"><h3>Most read</h3><ol><li><a href="/1">Cat returns after nine years</a><li><a href="/2">Why the market hall stays shut</a><li><a href="/3">Weather: more rain</a></ol>
<form action="/newsletter"><label>Get our newsletter</label><input name=mail><button>Subscribe</button></form></div></div>
<div id="comments"><h3>3 comments</h3><div class="comment"><b>harry</b><p>About time, I have been saying this for years and nobody ever listened to me.</p></div><div class="comment"><b>lena</b><p>And who pays the other half? The people of this town, as always.</p></div></div>
<div class="bottom"><p>&copy; 2021 The Daily Post. All rights reserved.</p><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></div></body></html>""",
        "Harbour bridge closed for six weeks\nThe old harbour bridge will be closed to all traffic from Monday, the city council said yesterday.\nEngineers found cracks in two of the four pillars. “Nobody was ever in danger,” said the head of the works department, “but we will not wait until somebody is.”\nBuses will take the northern bridge. The ferry, which last ran in 1987, is to carry walkers and cyclists free of charge.\nWork is expected to cost about four million euros, of which the state pays half.",
    ),
    # a recipe: short blocks and lists are the text
    (
        """<html><body class="recipe-site"><header><a href="/">Kitchen notes</a> <a href="/all">All recipes</a></header>
<main><h1>Onion soup</h1><p>A soup for cold evenings that needs little more than patience.</p><h2>You need</h2><ul><li>1 kg of onions</li><li>50 g of butter</li><li>1 l of stock</li><li>old bread</li></ul>
<h2>What to do</h2><ol><li>Cut the onions into thin rings and melt the butter in a heavy pot.</li><li>Let the onions brown slowly for forty minutes and stir now and then.</li><li>Pour on the stock and let it boil for ten minutes.</li></ol>
<p>Serve it with toasted bread.</p></main>
<aside class="sidebar"><h4>About me</h4><p>I cook, my husband eats, and the dog takes what is left.</p></aside>
<footer><p>Cookies help us to run this site. <a href="/c">More</a></p></footer></body></html>""",
        "Onion soup\nA soup for cold evenings that needs little more than patience.\nYou need\n1 kg of onions\n50 g of butter\n1 l of stock\nold bread\nWhat to do\nCut the onions into thin rings and melt the butter in a heavy pot.\nLet the onions brown slowly for forty minutes and stir now and then.\nPour on the stock and let it boil for ten minutes.\nServe it with toasted bread.",
    ),
    # an old page of tables and line breaks
    (
        """<HTML><BODY bgcolor=white><TABLE width=100%><TR><TD class=menu width=150><A HREF=index.htm>Home</A><BR><A HREF=links.htm>Links</A><BR><A HREF=guest.htm>Guestbook</A></TD>
<TD class=content><H2>The mill on the upper river</H2>The mill was built in 1742 by a farmer whose name nobody wrote down. It ground rye for three villages until the railway came.<BR><BR>In 1911 the wheel was sold, and a sawmill took over the building, which burned down in the dry summer of 1947. Only the lower walls are left.</TD></TR></TABLE>
<HR><CENTER><FONT size=1>You are visitor no. 10432 - <A HREF=mailto:x@example.org>webmaster</A></FONT></CENTER></BODY></HTML>""",
        None,
    ),
    # a blog post with nested adverts, share buttons and a notice
    (
        """<html><body><div class="cookie-notice"><p>We use cookies to give you the best experience on our website.</p><button>Accept all</button></div>
<nav class="menu"><a href="/">Home</a><a href="/blog">Blog</a><a href="/about">About</a></nav>
<div class="post"><div class="post-header"><h1 class="post-title">Walking along the dyke</h1></div><div class="post-body">
<p>Last Sunday we walked along the dyke from the lighthouse to the old sluice, eleven kilometres with the wind in our faces.</p>
<div class="ad-slot"><div class="ad-inner"><p>Boots for every weather - now 20% off in our shop!</p><a href="/shop">Buy now</a></div></div>
<p>There were geese everywhere. They rise when you come too near, circle once over the meadow and come down behind you, as if nothing had happened.</p>
<p>At the sluice there is a small inn which opens at noon. We had pea soup, and then we took the bus home because it had begun to rain.</p></div>
<div class="share"><a href="#">Share</a><a href="#">Tweet</a></div></div>
<section class="related"><h3>You may also like</h3><a href="/p/1">A winter on the island</a><a href="/p/2">Ten bakeries worth a detour</a></section>
<section class="responses"><h3>Responses</h3><div class="comment"><p>Lovely, we did the same walk in May and there were lambs all over the dyke.</p></div></section>
<footer class="site-footer">Made with tea. <a href="/rss">RSS</a></footer></body></html>""",
        "Walking along the dyke\nLast Sunday we walked along the dyke from the lighthouse to the old sluice, eleven kilometres with the wind in our faces.\nThere were geese everywhere. They rise when you come too near, circle once over the meadow and come down behind you, as if nothing had happened.\nAt the sluice there is a small inn which opens at noon. We had pea soup, and then we took the bus home because it had begun to rain.",
    ),
    # article inside section, with links in the text, a figure and a quotation
    (
        """<html><body><section id="content"><h1>Why the swifts came late</h1><p>In most years the <a href="/b/swift">swifts</a> reach our town on the first of May. This year they came on the <a href="/d">eleventh</a>, later than in any year since the counts began.</p>
<blockquote>They left Africa in time, but a cold front held them up south of the mountains for nine days.</blockquote>
<p>For the birds the delay means one brood at best, says the ornithologist, who has ringed more than two thousand of them.</p><h2>What one can do</h2><p>Leave the holes under the roof open, and hang a box if there are none.</p></section>
<section id="sidebar"><h3>Tags</h3><a href="/t/1">birds</a> <a href="/t/2">spring</a> <a href="/t/3">weather</a></section>
<div role="contentinfo"><a href="/contact">Contact</a> | <a href="/terms">Terms of use</a></div></body></html>""",
        "Why the swifts came late\nIn most years the swifts reach our town on the first of May. This year they came on the eleventh, later than in any year since the counts began.\nThey left Africa in time, but a cold front held them up south of the mountains for nine days.\nFor the birds the delay means one brood at best, says the ornithologist, who has ringed more than two thousand of them.\nWhat one can do\nLeave the holes under the roof open, and hang a box if there are none.",
    ),
]
PAGES[2] = (
    PAGES[2][0],
    "The mill on the upper river\nThe mill was built in 1742 by a farmer whose name nobody wrote down. It ground rye for three villages until the railway came. In 1911 the wheel was sold, and a sawmill took over the building, which burned down in the dry summer of 1947. Only the lower walls are left.",
)

#: Written after the trainer's layouts were settled.
LATER = [
    (
        """<!doctype html><html><body><div id="page"><div id="masthead"><a href="/">The Valley Courier</a><div class="tagline">All the news of the valley since 1903</div></div>
<div id="navigation"><ul><li><a href="/news">News</a></li><li><a href="/farms">Farms</a></li><li><a href="/letters">Letters</a></li></ul></div>
<div id="main-content"><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/farms">Farms</a></div><h1>Early frost costs growers a third of the plums</h1>
<p class="lead">Two nights of frost in April have cost the fruit growers of the valley about a third of this year's plums.</p>
<p>&quot;We lit fires between the rows,&quot; said one of them, &quot;and still the blossoms turned brown.&quot;</p><div class="sponsored"><a href="/x">Sponsored: new tractors at old prices</a></div>
<p>Apples flower later and were spared. Cherries will be dearer than last summer.</p></div>
<div id="sidebar"><div class="widget"><h3>Weather</h3><p>Sunny, with a light wind from the west in the afternoon.</p></div></div>
<div id="footer"><p>Copyright the valley courier.</p></div></div></body></html>""",
        "Early frost costs growers a third of the plums\nTwo nights of frost in April have cost the fruit growers of the valley about a third of this year's plums.\n\"We lit fires between the rows,\" said one of them, \"and still the blossoms turned brown.\"\nApples flower later and were spared. Cherries will be dearer than last summer.",
    ),
    (
        """<html><head><title>FAQ</title></head><body><nav><a href="/">Start</a><a href="/faq">Questions</a></nav>
<div class="content"><h1>Questions about the library</h1><dl><dt>How long may I keep a book?</dt><dd>Four weeks, and four more if nobody else waits for it.</dd><dt>What does a card cost?</dt><dd>Nothing up to the age of eighteen, and twelve euros a year after that.</dd></dl></div>
<form class="search"><label>Search the catalogue</label><input><button>Go</button></form><footer><a href="/imprint">Imprint</a></footer></body></html>""",
        "Questions about the library\nHow long may I keep a book?\nFour weeks, and four more if nobody else waits for it.\nWhat does a card cost?\nNothing up to the age of eighteen, and twelve euros a year after that.",
    ),
    (
        """<html><body><div class="topbar"><a href="/login">Log in</a> <a href="/cart">Cart (0)</a></div><article class="entry"><header><h1>Repairing a wicker chair</h1><p>What I learned from an old basket maker</p></header>
<p>Soak the cane for an hour in warm water, or it will split when you bend it.</p><pre>front rail: 11 strands, back rail: 9 strands</pre><p>Let the finished seat dry slowly, away from the stove.</p>
<section class="comments"><h2>2 replies</h2><article class="comment"><p>Thank you, my grandmother's chair can be sat upon again!</p></article><article class="comment"><p>Cold water works as well, it only takes longer.</p></article></section></article>
<aside><h2>Newsletter</h2><p>One letter a month, no more.</p></aside></body></html>""",
        "Repairing a wicker chair\nWhat I learned from an old basket maker\nSoak the cane for an hour in warm water, or it will split when you bend it.\nfront rail: 11 strands, back rail: 9 strands\nLet the finished seat dry slowly, away from the stove.",
    ),
]

"""Pages written by hand on which nothing is tuned, with their main text; the first half have no headings in it."""

_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
_FOOT = "<footer><p>&copy; 2019 Village Press. All rights reserved.</p></footer>"
_COOKIE = '<div class="cookie-banner"><p>This site uses cookies.</p><button>Fine</button></div>'

HELD = [
    (f"<html><body>{_NAV}<article><p>The ferry did not sail on Tuesday because of the ice.</p><div class='ad-box'><p>Buy two coats, pay for one.</p></div><p>It is hoped that it will sail again on Friday.</p></article>{_FOOT}</body></html>", "The ferry did not sail on Tuesday because of the ice.\nIt is hoped that it will sail again on Friday."),
    (f"<body>{_COOKIE}<article><p>Bread is baked here at four in the morning.</p></article>{_FOOT}", "Bread is baked here at four in the morning."),
    (f"<body>{_NAV}<main><blockquote>Nobody told us that the road would end.</blockquote><p>So began the letter that was found behind the stove.</p></main>{_FOOT}", "Nobody told us that the road would end.\nSo began the letter that was found behind the stove."),
    (f"<body>{_NAV}<div class='content'><ul><li>two eggs and a cup of milk</li><li>a pound of flour</li><li>salt</li></ul><p>Stir it all together and wait an hour.</p></div><div class='sidebar'><h3>Popular</h3><ul><li><a href='#'>Soups</a></li><li><a href='#'>Cakes</a></li></ul></div>{_FOOT}", "two eggs and a cup of milk\na pound of flour\nsalt\nStir it all together and wait an hour."),
    (f"<body><header><a href='/'>The Lamp</a></header><article><p>A short note on lamps.</p><form action='/s'><label>Your mail</label><input name='m'><button>Send</button></form><p>Trim the wick every evening, and never fill a lamp that burns.</p></article>{_FOOT}", "A short note on lamps.\nTrim the wick every evening, and never fill a lamp that burns."),
    ("<p>The only paragraph of this page speaks of the weather in June.</p>", "The only paragraph of this page speaks of the weather in June."),
    (f"<body>{_NAV}<article><table><tr><th>Train</th><td>leaves at noon</td></tr><tr><th>Boat</th><td>leaves at dusk</td></tr></table><p>Tickets are sold on board.</p></article>{_FOOT}", "Train\nleaves at noon\nBoat\nleaves at dusk\nTickets are sold on board."),
    (f"<body>{_NAV}<div id='main'><p>We walked along the canal until it grew dark.</p><p>Then we walked back.</p></div><div id='comments'><div class='comment'><p>I know that canal well, my uncle worked there.</p></div></div>{_FOOT}", "We walked along the canal until it grew dark.\nThen we walked back."),
    (f"<body>{_COOKIE}{_NAV}<article><p>Yes.</p></article><div class='related'><h3>Read on</h3><ul><li><a href='#'>No</a></li><li><a href='#'>Perhaps</a></li></ul></div>{_FOOT}", "Yes."),
    (f"<body>{_NAV}<section class='story'><p>The clock struck, and nobody looked up.</p><p>It struck again.</p><aside class='promo'><p>Clocks and watches, half the price until Sunday!</p></aside><p>Only then did the judge raise a hand.</p></section>{_FOOT}", "The clock struck, and nobody looked up.\nIt struck again.\nOnly then did the judge raise a hand."),
    (f"<body><div class='topbar'><a href='/'>Start</a> <a href='/shop'>Shop</a></div><article><p>Wool must be washed cold.</p><p>Dry it flat.</p></article><div class='newsletter'><p>Letters from the farm, once a month.</p><form><input name='m'><button>Subscribe</button></form></div>{_FOOT}", "Wool must be washed cold.\nDry it flat."),
    (f"<body>{_NAV}<main><p>Der Markt wurde im Jahr 1604 zum ersten Mal erwähnt.</p><p>Heute wird dort nur noch im Herbst verkauft.</p></main><aside><h4>Mehr</h4><p>Karten und Bilder der alten Stadt.</p></aside>{_FOOT}", "Der Markt wurde im Jahr 1604 zum ersten Mal erwähnt.\nHeute wird dort nur noch im Herbst verkauft."),
    (f"<body>{_NAV}<article><h1>The orchard in March</h1><p>The trees are cut back before the sap rises.</p><h2>Tools</h2><ul><li>a saw</li><li>a ladder</li></ul></article>{_FOOT}", "The orchard in March\nThe trees are cut back before the sap rises.\nTools\na saw\na ladder"),
    (f"<body>{_COOKIE}<main><h1>Lost and found</h1><p>A grey cap was left on the bench.</p></main>{_FOOT}", "Lost and found\nA grey cap was left on the bench."),
    (f"<body><div class='masthead'>The Evening Star</div>{_NAV}<div class='article'><h1>Fire at the mill</h1><div class='share'><a href='#'>Share</a> <a href='#'>Print</a></div><p>The mill burned for two nights.</p><p>Nobody was hurt, the mayor said.</p></div>{_FOOT}", "Fire at the mill\nThe mill burned for two nights.\nNobody was hurt, the mayor said."),
    (f"<body>{_NAV}<article><header><h1>How bells are cast</h1></header><p>Bronze is poured into a mould of clay.</p><pre>copper 78 tin 22</pre></article><section class='comments'><h3>Two comments</h3><div class='comment'><p>My village has three of them.</p></div></section>{_FOOT}", "How bells are cast\nBronze is poured into a mould of clay.\ncopper 78 tin 22"),
    (f"<body>{_NAV}<main><article><h2>On patience</h2><p>It is the art of waiting.</p><p>It cannot be taught.</p></article></main><div class='sidebar'><p>Written by a retired teacher.</p></div>{_FOOT}", "On patience\nIt is the art of waiting.\nIt cannot be taught."),
    (f"<body>{_NAV}<div class='entry'><h1>Chess by post</h1><p>A game takes about two years.</p><div class='advert'>Stamps by the sheet</div><p>Each move is sent on a card.</p><ol><li>e4 e5</li><li>Nf3 Nc6</li></ol></div>{_FOOT}", "Chess by post\nA game takes about two years.\nEach move is sent on a card.\ne4 e5\nNf3 Nc6"),
    (f"<body>{_NAV}<article><h1>Le pont neuf</h1><p>Le pont fut achevé en 1607.</p><blockquote><p>Il durera mille ans.</p></blockquote></article>{_FOOT}", "Le pont neuf\nLe pont fut achevé en 1607.\nIl durera mille ans."),
    (f"<body>{_NAV}{_COOKIE}<div id='content'><h1>Opening hours</h1><table><tr><td>Monday</td><td>nine to five</td></tr><tr><td>Sunday</td><td>closed</td></tr></table></div>{_FOOT}", "Opening hours\nMonday\nnine to five\nSunday\nclosed"),
    (f"<body>{_NAV}<article><h1>Snow</h1><p>Snow fell.</p></article><aside class='related'><h3>Also of interest</h3><ul><li><a href='#'>Rain</a></li><li><a href='#'>Hail</a></li><li><a href='#'>Fog</a></li></ul></aside>{_FOOT}", "Snow\nSnow fell."),
    (f"<body>{_NAV}<div class='post'><h1>A new roof</h1><p>Slate was brought from the quarry by cart.</p><p>The men worked <a href='/dawn'>from dawn</a> until the bell rang.</p></div><div class='pagination'><a href='#'>1</a><a href='#'>2</a></div>{_FOOT}", "A new roof\nSlate was brought from the quarry by cart.\nThe men worked from dawn until the bell rang."),
    (f"<body>{_NAV}<article><h1>Questions</h1><dl><dt>Who may come?</dt><dd>All who bring a chair.</dd><dt>What does it cost?</dt><dd>Nothing.</dd></dl></article>{_FOOT}", "Questions\nWho may come?\nAll who bring a chair.\nWhat does it cost?\nNothing."),
    (f"<body>{_NAV}<main><h1>The well</h1><p>It is ninety feet deep.</p><figure><img src='w.jpg'><figcaption>The well in 1910</figcaption></figure><p>The water tastes of iron.</p></main>{_FOOT}", "The well\nIt is ninety feet deep.\nThe well in 1910\nThe water tastes of iron."),
]

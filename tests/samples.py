"""Values that several test modules share."""

from __future__ import annotations

from datetime import datetime, timezone

NOW = datetime(2026, 1, 2, tzinfo=timezone.utc)

# A made-up shop for kitchen software, with a bit of everything the page functions look for.
HOMEPAGE = """<html>
<head>
<meta property="og:title" content="ignored">
<title>Ladle Metrics - Kitchen Analytics</title>
<meta content="Ladle Metrics tells hotel kitchens which dishes earn their place." name="description">
<link href="/wp-includes/print.css" rel="stylesheet">
<style>h9{margin:1em}</style>
</head>
<body class="front">
<script async src="//cdn.segment.com/v2/k.js"></script>
<header><a href="#menu">Menu</a> <a href="tel:+4712">Call</a>
<a href="/pricing/">Plans</a> <a href="https://jobs.lever.co/ladle">Join us</a> <a href="/login">Log in</a></header>
<div id="x"><h1>Kitchen analytics for B2B SaaS caterers</h1>
<p>Every webinar, recipe and data dashboard in one enterprise report, so chefs and buyers
see at a glance what was cooked, what was eaten and what went back.</p>
<p><a href="/demo">Book a demo</a> &mdash; or read our <a href="/customers/">case studies</a>.</p>
<h2>Safe hands</h2>
<ul><li>SSO and audit logs</li><li>SOC 2 reports for enterprise kitchens</li></ul>
<script>var pan = "hot";</script></div>
<img src="https://js.hs-scripts.com/77.js" alt="">
<p>&#169; Ladle</p>
</body>
</html>
"""

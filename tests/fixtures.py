"""Inputs of the end-to-end test: one invented engineer in four sources."""
import json

# The id of a known result is a digest of this address, and that result's years are those of the dates 2018 to now.
MAIL = "priya.sharma@email.com"

CSV = f"name,email,phone,current_company,title\nNadia Okonkwo,{MAIL},(628) 555-0134,Harbor Labs,Data Platform Lead\n"
USER = {
    "user": {"login": "nokonkwo", "name": "Nadia O.", "bio": "Builds pipelines", "location": "Oakland, CA", "blog": "https://nadia.example", "html_url": "https://github.com/nokonkwo", "followers": 4},
    "repos": [
        {"name": "tidewater", "language": "Scala", "stargazers_count": 31, "fork": False},
        {"name": "mooring", "language": "Python", "stargazers_count": 90, "fork": False},
        {"name": "forked-thing", "language": "Python", "stargazers_count": 4000, "fork": True},
        {"name": "notes", "language": "Python", "stargazers_count": 2, "fork": False},
        {"name": "charts", "language": "R", "stargazers_count": 45, "description": None},
    ],
}
JSON = json.dumps(USER)
HTML = """<html><head><title>N</title><link href="https://www.linkedin.com/in/nadia-o/" rel="canonical"></head><body>
<header><h1 class="full-name">Nadia Okonkwo</h1><div class="tagline">Data Platform Lead | Streams</div><div class="address">Oakland &amp; nearby</div></header>
<section><h2>Experience</h2><ol>
<li><b class="position">Data Platform Lead</b><i class="org">Harbor Labs</i><u class="duration">Mar 2021 – Present</u></li>
<li><b class="position">Pipeline Engineer</b><i class="org">Quayside</i><u class="duration">Feb 2018 – Feb 2021</u></li>
<li>ok</li></ol></section>
<section><h2>Education</h2><ol><li><b class="university">Lagos Institute</b><i class="study">BSc Statistics</i><u class="years">2014 – 2017</u></li></ol></section>
<section><h2>Top skills</h2><div><span>Python</span><span>R</span><span>k8s</span><span>Spark SQL</span></div></section></body></html>"""
RESUME = f"""Nadia Okonkwo
{MAIL} / (628) 555-0134 / Oakland, CA

OBJECTIVE
Make data arrive
on time.

EMPLOYMENT
Data Platform Lead
Harbor Labs | Mar 2021 - Present
Moved nightly jobs to streams.
Cut their cost.
Pipeline Engineer at Quayside, Feb 2018 - Feb 2021
Wrote loaders.

EDUCATION
Bachelor of Science in Statistics
Lagos Institute, 2014 - 2017

TECHNOLOGIES
python3, k8s • Spark SQL | C
"""

"""Signatures of licences: hand-written expressions over normalised words, in order of priority.

A text is read as lower-case words with one space between, so ``GPL-3.0-or-later`` is ``gpl 3 0 or later``.
Each line holds a label, the strength of the evidence in percent, the words that must all be in a text before
the expression is tried, and the expression.  An expression begins and ends at a word's edge.  Of detections
of which one lies within another, the line that comes first wins (``licenses``), so what is specific stands
above what is general: identifiers and grants with versions, then titles, then mentions.
"""

from __future__ import annotations

#: Base phrases, whose labels always stay.
BASE = """
gpl | gnu general public license
apache | apache license
cc-by | cc by
mit | mit license
"""

RULES = r"""
gpl-3.0-or-later | 98 | gpl or later | spdx license identifier gpl 3 0 or later
gpl-3.0-only | 98 | gpl only | spdx license identifier gpl 3 0 only
gpl-2.0-or-later | 98 | gpl or later | spdx license identifier gpl 2 0 or later
gpl-2.0-only | 98 | gpl only | spdx license identifier gpl 2 0 only
gpl-2.0-with-classpath-exception | 98 | gpl classpath | gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2.0-with-classpath-exception | 90 | classpath exception | gnu general public license version 2(?: only)?(?: \S+){0,6} classpath exception
gpl-2.0-with-classpath-exception | 90 | statically linking independent | linking this library statically or dynamically with other modules(?: \S+){0,24} independent modules
gpl-2.0-with-linux-syscall-note | 98 | gpl syscall | gpl 2 0(?: only| or later)? with linux syscall note
gpl-3.0-with-gcc-exception | 95 | gpl gcc exception | gpl 3 0(?: only| or later)? with gcc exception 3 1
gpl-3.0-with-gcc-exception | 88 | gcc runtime exception | gcc runtime library exception(?: version 3 1)?
gpl-with-font-exception | 88 | font exception | gpl(?: \S+){0,4} with(?: the)? font exception
gpl-with-autoconf-exception | 88 | autoconf exception | gpl(?: \S+){0,4} with autoconf exception
gpl-3.0-or-later | 95 | gnu either | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | 95 | gnu either | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-1.0-or-later | 95 | gnu either | gnu general public license as published by the free software foundation either version 1(?: of the license)? or at your option any later version
gpl-3.0-only | 92 | gnu published | gnu general public license(?: as)? version 3(?: only)? as published by the free software foundation
gpl-2.0-only | 92 | gnu published | gnu general public license(?: as)? version 2(?: only)? as published by the free software foundation
gpl-3.0-or-later | 90 | gplv3 later | gplv3(?: 0)? or(?: any)? later(?: version)?
gpl-2.0-or-later | 90 | gplv2 later | gplv2(?: 0)? or(?: any)? later(?: version)?
gpl-3.0-or-later | 90 | gpl later | gpl (?:v3|(?:v |version )?3)(?: 0)? or(?: any)? later(?: version)?
gpl-2.0-or-later | 90 | gpl later | gpl (?:v2|(?:v |version )?2)(?: 0)? or(?: any)? later(?: version)?
gpl-3.0-or-later | 88 | gnu later | gnu general public license(?: gpl)? (?:v|version )?3(?: 0)? or(?: \S+){0,4} later
gpl-2.0-or-later | 88 | gnu later | gnu general public license(?: gpl)? (?:v|version )?2(?: 0)? or(?: \S+){0,4} later
gpl-3.0 | 85 | gnu version | gnu general public license(?: gpl)?(?: as published by the free software foundation)? version 3(?: 0)?
gpl-2.0 | 85 | gnu version | gnu general public license(?: gpl)?(?: as published by the free software foundation)? version 2(?: 0)?
gpl-1.0 | 85 | gnu version | gnu general public license(?: gpl)? version 1(?: 0)?
gpl-3.0 | 85 | gnu | gnu general public license(?: gpl)? v ?3(?: 0)?
gpl-2.0 | 85 | gnu | gnu general public license(?: gpl)? v ?2(?: 0)?
gpl-3.0 | 80 | gnu version | version 3(?: 0)? of the gnu general public license
gpl-2.0 | 80 | gnu version | version 2(?: 0)? of the gnu general public license
gpl-3.0 | 80 | gplv3 | (?:gnu )?gplv3(?: 0)?
gpl-2.0 | 80 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-3.0 | 78 | gpl 3 | (?:gnu )?gpl (?:v |version )?3(?: 0)?
gpl-2.0 | 78 | gpl 2 | (?:gnu )?gpl (?:v |version )?2(?: 0)?
gpl-3.0 | 78 | gpl v3 | (?:gnu )?gpl v3(?: 0)?
gpl-2.0 | 78 | gpl v2 | (?:gnu )?gpl v2(?: 0)?
gpl-3.0 | 85 | gnu org gpl | gnu org licenses(?: old licenses)? gpl 3 0
gpl-2.0 | 85 | gnu org gpl | gnu org licenses old licenses gpl 2 0
lgpl-3.0-or-later | 98 | lgpl later | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | 98 | lgpl only | spdx license identifier lgpl 3 0 only
lgpl-2.1-or-later | 98 | lgpl later | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | 98 | lgpl only | spdx license identifier lgpl 2 1 only
lgpl-2.0-or-later | 98 | lgpl later | spdx license identifier lgpl 2 0 or later
lgpl-3.0-or-later | 95 | gnu lesser either | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | 95 | gnu lesser either | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.0-or-later | 95 | gnu library either | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-3.0 | 85 | lesser version | gnu lesser general public license(?: lgpl)? version 3(?: 0)?
lgpl-2.1 | 85 | lesser version | gnu lesser general public license(?: lgpl)? version 2 1
lgpl-2.0 | 85 | library version | gnu library general public license(?: lgpl)? version 2(?: 0)?
lgpl-3.0 | 85 | lesser v3 | gnu lesser general public license v3(?: 0)?
lgpl-2.1 | 85 | lesser v2 1 | gnu lesser general public license v2 1
lgpl-3.0 | 78 | lgplv3 | (?:gnu )?lgplv3(?: 0)?
lgpl-2.1 | 78 | lgplv2 1 | (?:gnu )?lgplv2 1
lgpl-3.0 | 78 | lgpl 3 | (?:gnu )?lgpl (?:version )?3(?: 0)?
lgpl-2.1 | 78 | lgpl 2 1 | (?:gnu )?lgpl (?:version )?2 1
lgpl-2.1 | 78 | lgpl v2 1 | (?:gnu )?lgpl v2 1
agpl-3.0-or-later | 98 | agpl later | spdx license identifier agpl 3 0 or later
agpl-3.0-only | 98 | agpl only | spdx license identifier agpl 3 0 only
agpl-3.0-or-later | 95 | affero either | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | 85 | affero gnu | gnu affero general public license(?: agpl)? (?:version )?v?3(?: 0)?
agpl-3.0 | 78 | agplv3 | (?:gnu )?agplv3(?: 0)?
agpl-3.0 | 78 | agpl 3 | (?:gnu )?agpl (?:v |version )?3(?: 0)?
agpl-1.0 | 80 | affero version | affero general public license version 1(?: 0)?
gfdl-1.3 | 88 | documentation free | gnu free documentation license version 1 3
gfdl-1.2 | 88 | documentation free | gnu free documentation license version 1 2
gfdl-1.1 | 88 | documentation free | gnu free documentation license version 1 1
gfdl | 75 | gfdl | gfdl(?: 1 [123])?
apache-2.0 | 98 | spdx apache | spdx license identifier apache 2 0
apache-2.0-with-llvm-exception | 98 | apache llvm | apache(?: license)?(?: version)? 2 0 with llvm exceptions?
apache-2.0 | 95 | apache except compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 92 | apache version | licensed under the apache license version 2 0
apache-2.0 | 90 | apache org | apache org licenses license 2 0
apache-2.0 | 85 | apache | apache(?: software)? license(?: version)? 2(?: 0)?
apache-2.0 | 85 | apache | apache(?: software)? license v2(?: 0)?
apache-1.1 | 85 | apache | apache(?: software)? license(?: version)? 1 1
apache-1.0 | 85 | apache | apache(?: software)? license(?: version)? 1 0
apache-2.0 | 78 | apache 2 | apache (?:v )?2(?: 0)?(?: licensed?)?
apache-2.0 | 78 | asl 2 | asl(?: version)? 2 0
apache-1.1 | 80 | includes apache | this product includes software developed by the apache software foundation
mit | 98 | spdx mit | spdx license identifier mit
mit-0 | 95 | mit 0 | (?:spdx license identifier )?mit 0(?: license)?
mit | 97 | granted charge deal | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit | 90 | merchantability noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 90 | mit released | released under the(?: terms of the)? mit license
mit | 90 | mit licensed | licensed under the(?: terms of the)? mit license
mit | 88 | opensource mit | opensource org licenses mit(?: license)?
mit | 80 | expat | expat license
mit | 70 | mit license | the mit license
mit | 65 | mit licensed | mit licensed
mit-cmu | 85 | cmu license | (?:mit )?cmu license
x11 | 85 | x11 license | (?:mit )?x11 license
isc | 98 | spdx isc | spdx license identifier isc
isc | 95 | permission modify distribute fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 85 | isc license | isc license
0bsd | 95 | 0bsd | (?:spdx license identifier )?0bsd
0bsd | 85 | zero clause bsd | zero clause bsd(?: license)?
bsd-3-clause | 98 | spdx bsd 3 | spdx license identifier bsd 3 clause
bsd-2-clause | 98 | spdx bsd 2 | spdx license identifier bsd 2 clause
bsd-4-clause | 98 | spdx bsd 4 | spdx license identifier bsd 4 clause
bsd-3-clause-clear | 92 | bsd clear | (?:bsd 3 clause clear|clear bsd)(?: license)?
bsd-4-clause | 92 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | 92 | neither endorse promote | neither the name of(?: \S+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd | 88 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 80 | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 85 | bsd 3 clause | bsd 3 clause(?: new| revised)?(?: license)?
bsd-2-clause | 85 | bsd 2 clause | bsd 2 clause(?: simplified)?(?: license)?
bsd-4-clause | 85 | bsd 4 clause | bsd 4 clause(?: original)?(?: license)?
bsd-3-clause | 82 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-2-clause | 82 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-3-clause | 82 | bsd license | (?:new|modified|revised) bsd license
bsd-3-clause | 82 | three clause bsd | three clause bsd(?: license)?
bsd-2-clause | 82 | bsd license | (?:simplified|freebsd) bsd license
bsd-2-clause | 82 | two clause bsd | two clause bsd(?: license)?
bsd | 70 | bsd style | bsd style licen[cs]e
bsd | 70 | bsd license | bsd license
bsd | 60 | bsd licensed | bsd licensed
mpl-2.0 | 98 | spdx mpl 2 | spdx license identifier mpl 2 0
mpl-1.1 | 98 | spdx mpl 1 | spdx license identifier mpl 1 1
mpl-2.0 | 95 | mozilla subject terms | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 | 92 | mozilla contents subject | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | 88 | mozilla org | mozilla org mpl 2 0
mpl-2.0 | 85 | mozilla public | mozilla public license(?: mpl)?(?: version| v)? 2(?: 0)?
mpl-1.1 | 85 | mozilla public | mozilla public license(?: mpl)?(?: version| v)? 1 1
mpl-1.0 | 85 | mozilla public | mozilla public license(?: mpl)?(?: version| v)? 1 0
mpl-2.0 | 78 | mpl 2 | mpl (?:v |version )?2(?: 0)?
mpl | 65 | mozilla public | mozilla public license
epl-2.0 | 98 | spdx epl 2 | spdx license identifier epl 2 0
epl-1.0 | 98 | spdx epl 1 | spdx license identifier epl 1 0
epl-2.0 | 88 | eclipse public | eclipse public license(?: epl)?(?: version| v)? 2(?: 0)?
epl-1.0 | 88 | eclipse public | eclipse public license(?: epl)?(?: version| v)? 1(?: 0)?
epl | 70 | eclipse public | eclipse public license
edl-1.0 | 85 | eclipse distribution | eclipse distribution license(?: v| version)?(?: 1 0)?
cddl-1.1 | 88 | cddl | cddl(?: license)?(?: version)? 1 1
cddl-1.0 | 88 | cddl | cddl(?: license)?(?: version)? 1 0
cddl-1.0 | 85 | common development distribution | common development and distribution license(?: cddl)?(?: version| v)?(?: 1 0)?
cddl | 70 | cddl | cddl
cpl-1.0 | 85 | common public | common public license(?: version| v)?(?: 1 0)?
ipl-1.0 | 85 | ibm public | ibm public license(?: version| v)?(?: 1 0)?
eupl-1.2 | 92 | eupl 1 2 | eupl(?: version| v)? 1 2
eupl-1.1 | 92 | eupl 1 1 | eupl(?: version| v)? 1 1
eupl | 80 | european union public | european union public licen[cs]e(?: v(?:ersion)?)?(?: 1 [012])?
cecill-2.1 | 90 | cecill 2 | cecill(?: license| licence)?(?: version)? 2 1
cecill-b | 88 | cecill b | cecill b
cecill-c | 88 | cecill c | cecill c
cecill | 75 | cecill | cecill
osl-3.0 | 88 | open software license | open software license(?: version| v)? 3 0
osl-2.1 | 88 | open software license | open software license(?: version| v)? 2 1
afl-3.0 | 88 | academic free license | academic free license(?: version| v)? 3 0
afl-2.1 | 88 | academic free license | academic free license(?: version| v)? 2 1
artistic-2.0 | 90 | artistic license 2 | artistic license(?: version| v)? 2 0
artistic-1.0 | 88 | artistic license 1 | artistic license(?: version| v)? 1 0
artistic-or-gpl | 85 | same terms perl | (?:under )?the same terms as perl(?: 5)? itself
artistic | 70 | artistic license | (?:perl )?artistic license
bsl-1.0 | 98 | spdx bsl | spdx license identifier bsl 1 0
bsl-1.0 | 88 | boost software | (?:distributed under the )?boost software license(?: version| v)?(?: 1 0)?
busl-1.1 | 88 | business source | business source license(?: version| v)?(?: 1 1)?
busl-1.1 | 85 | busl 1 | busl 1 1
elastic-2.0 | 88 | elastic | elastic license(?: version| v)? ?2(?: 0)?
elastic | 75 | elastic license | elastic license
sspl-1.0 | 88 | server side public | server side public license(?: sspl)?(?: version| v)?(?: 1)?
sspl-1.0 | 80 | sspl | sspl(?: v1| 1 0)?
polyform-noncommercial-1.0.0 | 88 | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
polyform-shield-1.0.0 | 88 | polyform shield | polyform shield license(?: 1 0 0)?
polyform-small-business-1.0.0 | 88 | polyform business | polyform small business license(?: 1 0 0)?
commons-clause | 88 | commons clause | commons clause(?: license)? condition(?: v1 0)?
commons-clause | 75 | commons clause | commons clause
unlicense | 98 | spdx unlicense | spdx license identifier unlicense
unlicense | 95 | unencumbered public domain | this is free and unencumbered software released into the public domain
unlicense | 85 | unlicense org | (?:http |https )?(?:www )?unlicense org
unlicense | 75 | unlicense | the unlicense
cc0-1.0 | 98 | spdx cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 92 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 90 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 85 | creative commons zero | creative commons zero(?: v1 0| 1 0)?(?: universal)?
cc0 | 75 | cc0 | cc0
pddl-1.0 | 85 | pddl | pddl(?: 1 0| v1 0)?
pddl-1.0 | 85 | public domain dedication | public domain dedication and licen[cs]e
odbl-1.0 | 88 | odbl | odbl(?: 1 0| v1 0)?
odbl-1.0 | 88 | open database license | open database license(?: odbl)?(?: v1 0)?
odc-by-1.0 | 88 | open data commons attribution | open data commons attribution license(?: odc by)?(?: v1 0)?
odc-by-1.0 | 85 | odc by | odc by(?: 1 0| v1 0)?
cdla-permissive-2.0 | 88 | cdla permissive | cdla permissive(?: v)? 2 0
cdla-permissive-1.0 | 88 | cdla permissive | cdla permissive(?: v)? 1 0
cdla-sharing-1.0 | 88 | cdla sharing | cdla sharing(?: v)?(?: 1 0)?
cc-by-nc-nd-4.0 | 92 | cc by nc nd | cc by nc nd(?: v)? 4 0(?: international)?
cc-by-nc-nd-3.0 | 92 | cc by nc nd | cc by nc nd(?: v)? 3 0(?: unported)?
cc-by-nc-sa-4.0 | 92 | cc by nc sa | cc by nc sa(?: v)? 4 0(?: international)?
cc-by-nc-sa-3.0 | 92 | cc by nc sa | cc by nc sa(?: v)? 3 0(?: unported)?
cc-by-nc-4.0 | 92 | cc by nc 4 | cc by nc(?: v)? 4 0(?: international)?
cc-by-nc-3.0 | 92 | cc by nc 3 | cc by nc(?: v)? 3 0(?: unported)?
cc-by-nd-4.0 | 92 | cc by nd 4 | cc by nd(?: v)? 4 0(?: international)?
cc-by-nd-3.0 | 92 | cc by nd 3 | cc by nd(?: v)? 3 0(?: unported)?
cc-by-sa-4.0 | 92 | cc by sa 4 | cc by sa(?: v)? 4 0(?: international)?
cc-by-sa-3.0 | 92 | cc by sa 3 | cc by sa(?: v)? 3 0(?: unported)?
cc-by-sa-2.5 | 92 | cc by sa 2 | cc by sa(?: v)? 2 5(?: generic)?
cc-by-4.0 | 90 | cc by 4 | cc by(?: v)? 4 0(?: international)?
cc-by-3.0 | 90 | cc by 3 | cc by(?: v)? 3 0(?: unported)?
cc-by-2.5 | 90 | cc by 2 | cc by(?: v)? 2 5(?: generic)?
cc-by-2.0 | 90 | cc by 2 | cc by(?: v)? 2 0(?: generic)?
cc-by-nc-nd-4.0 | 92 | creativecommons nc nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | 92 | creativecommons nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | 92 | creativecommons nc | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 92 | creativecommons nd | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | 92 | creativecommons sa | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 92 | creativecommons sa | creativecommons org licenses by sa 3 0
cc-by-4.0 | 92 | creativecommons licenses | creativecommons org licenses by 4 0
cc-by-3.0 | 92 | creativecommons licenses | creativecommons org licenses by 3 0
cc-by-nc-nd-4.0 | 90 | attribution noncommercial noderivatives | (?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 | 90 | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-4.0 | 90 | attribution noncommercial | (?:creative commons )?attribution noncommercial 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nd-4.0 | 90 | attribution noderivatives | (?:creative commons )?attribution noderivatives 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-4.0 | 90 | attribution sharealike | (?:creative commons )?attribution sharealike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-3.0 | 90 | attribution 3 | (?:creative commons )?attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-4.0 | 90 | creative commons attribution | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-3.0 | 90 | creative commons attribution | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-nd | 75 | cc by nc nd | cc by nc nd
cc-by-nc-sa | 75 | cc by nc sa | cc by nc sa
cc-by-nc | 75 | cc by nc | cc by nc
cc-by-nd | 75 | cc by nd | cc by nd
cc-by-sa | 75 | cc by sa | cc by sa
creative-commons | 60 | creative commons | creative commons(?: \S+){0,3} licen[cs]e
python-2.0 | 88 | python software foundation license | python software foundation license(?: version)?(?: 2)?
psf-2.0 | 85 | psf license | psf(?: 2 0)? license
zlib | 98 | spdx zlib | spdx license identifier zlib
zlib | 92 | misrepresented claim wrote | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 80 | zlib license | zlib(?: libpng)? license
libpng | 80 | libpng license | libpng license
openssl | 88 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 80 | openssl license | openssl license
curl | 80 | curl license | curl license
php-3.01 | 85 | php license | php license(?: version| v)? 3 0 ?1
php | 70 | php license | php license
ruby | 75 | ruby license | ruby license
vim | 80 | vim license | vim license
wtfpl | 92 | wtfpl | wtfpl(?: v2| version 2)?
wtfpl | 92 | fuck want public license | do what the fuck you want to public license
beerware | 88 | beerware | beerware(?: license)?(?: revision 42)?
json | 85 | good evil | the software shall be used for good not evil
ms-pl | 85 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 85 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
ncsa | 85 | ncsa illinois license | university of illinois ncsa open source license
ofl-1.1 | 88 | sil font license | sil open font license(?: version| v)?(?: 1 1)?
upl-1.0 | 85 | universal permissive license | universal permissive license(?: v)?(?: 1 0)?
w3c | 85 | w3c software license | w3c software(?: and document)?(?: notice and)? license
postgresql | 85 | postgresql license | postgresql license
unicode | 85 | unicode license | unicode(?: \S+){0,3} license agreement
blueoak-1.0.0 | 88 | blue oak license | blue oak model license(?: 1 0 0)?
mulan-2.0 | 88 | mulan | mulan psl(?: v2| 2 0)?|mulan permissive software license(?: v2| version 2)?
hippocratic | 80 | hippocratic license | hippocratic license(?: \S+){0,2}
openrail-m | 88 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?
rail | 75 | responsible ai | responsible ai licen[cs]e
llama-community | 85 | llama community license | llama(?: 2| 3| 3 1| 3 2)? community license(?: agreement)?
gemma-terms | 80 | gemma terms | gemma terms of use
ogl-uk-3.0 | 85 | open government | open government licen[cs]e(?: v)?(?: ?3 0)?
etalab-2.0 | 85 | etalab | (?:licence ouverte )?etalab(?: 2 0)?
public-domain | 75 | placed public domain | (?:is|was|been|hereby) placed in the public domain
public-domain | 72 | dedicated public domain | dedicated to the public domain
public-domain | 70 | released public domain | released (?:in)?to the public domain
public-domain | 45 | public domain | public domain
proprietary | 75 | proprietary confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 70 | unauthorized copying prohibited | unauthorized copying of this(?: \S+){1,8} strictly prohibited
proprietary | 55 | rights reserved | all rights reserved
proprietary | 60 | rechte vorbehalten | alle rechte vorbehalten
proprietary | 60 | tous droits | tous droits r\S+s
proprietary | 60 | todos derechos | todos los derechos reservados
noncommercial | 65 | non commercial only | for non commercial(?: \S+){0,2} (?:use|purposes) only
noncommercial | 65 | noncommercial only | for noncommercial(?: \S+){0,2} (?:use|purposes) only
research-only | 65 | research only | for research(?: \S+){0,3} (?:use|purposes) only
gpl | 70 | gnu gpl | gnu gpl
gpl | 60 | gpl | gpl licen[cs]ed?
gpl | 55 | gnu public | gnu(?: general)? public licen[cs]e
lgpl | 65 | gnu general public | gnu (?:lesser|library) general public license
lgpl | 55 | lgpl | lgpl
agpl | 65 | affero | (?:gnu )?affero general public license
agpl | 55 | agpl | agpl
gpl | 45 | gpl | gpl
gfdl | 60 | free documentation license | gnu free documentation license
apache | 60 | apache licensed | apache licensed
copyright-notice | 35 | copyright | copyright(?: c)?(?: \d{4})+(?: \S+){1,4}
spdx-other | 50 | spdx identifier | spdx license identifier \S+
"""

"""Signature rules for license texts.

One rule a line: label, priority, keyword, pattern. Texts are compared as words (runs of
ASCII letters and digits in lower case and of other characters) with one space between them, and
a space in a pattern stands between two words. The keyword is a word of every match, but for those
of ``JOINED``. Priority 3: full names and grants that name the version; 2:
names of a family and clauses of its text; 1: hints that something is licensed.
"""

from __future__ import annotations

#: The phrases and labels that are always reported.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

RULES = """
mit|3|mit|the mit license(?: mit)?
mit|2|mit|mit license
mit|3|mit|licensed under (?:the )?(?:terms of the )?mit(?: license)?
mit|3|mit|released under (?:the )?mit(?: license)?
mit|3|mit|distributed under (?:the )?(?:terms of the )?mit(?: license)?
mit|3|mit|spdx license identifier mit
mit|2|expat|expat license
mit|2|charge|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|2|portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|2|merge|without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit-0|3|attribution|mit no attribution(?: license)?
mit-0|3|mit|spdx license identifier mit 0
x11|3|x11|(?:the )?x11 license
apache|2|apache|apache license
apache-1.0|3|apache|apache (?:software )?license version 1 0
apache-1.1|3|apache|apache (?:software )?license(?: version)? 1 1
apache-2.0|3|apache|apache (?:software )?license(?: version)? 2 0
apache-2.0|3|apache|apache 2 0 license
apache-2.0|3|apache|licensed under (?:the )?apache(?: license)?(?: version)? 2(?: 0)?
apache-2.0|3|apache|spdx license identifier apache 2 0
apache-2.0|3|apache|www apache org licenses license 2 0
apache-2.0|2|compliance|you may not use this file except in compliance with the license
apache-2.0|2|writing|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0|2|contributor|each contributor hereby grants to you a perpetual worldwide
gpl|2|general|general public license
gpl|2|gnu|gnu general public license
gpl|2|gnu|gnu gpl
gpl|3|gpl|licensed under (?:the )?(?:gnu )?gpl
gpl|3|gpl|released under (?:the )?(?:gnu )?gpl
gpl|3|gpl|gpl license
gpl|3|gpl|gpl compatible
gpl-1.0|3|gpl|gpl (?:version |v)1(?: 0)?
gpl-1.0|3|gpl|spdx license identifier gpl 1 0(?: only| or later)?
gpl-1.0|3|general|(?:gnu )?general public license(?: as published by the free software foundation)? version 1
gpl-2.0|3|gpl|(?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?
gpl-2.0|3|gplv2|gplv2
gpl-2.0|3|gpl|spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0|3|general|(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 2
gpl-2.0|3|general|(?:gnu )?general public license v2
gpl-2.0|2|franklin|free software foundation inc 51 franklin street
gpl-2.0|2|temple|free software foundation inc 59 temple place
gpl-3.0|3|gpl|(?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?
gpl-3.0|3|gplv3|gplv3
gpl-3.0|3|gpl|spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0|3|general|(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 3
gpl-3.0|3|general|(?:gnu )?general public license v3
gpl|2|redistribute|you can redistribute it and or modify it under the terms of the gnu general public license
gpl|2|merchantability|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl|2|received|you should have received a copy of the gnu general public license
gpl|2|copyleft|copyleft
lgpl|2|lesser|(?:gnu )?lesser general public license
lgpl|2|library|(?:gnu )?library general public license
lgpl|3|lgpl|licensed under (?:the )?(?:gnu )?lgpl
lgpl|3|lgpl|(?:gnu )?lgpl license
lgpl-2.0|3|lgpl|(?:gnu )?lgpl (?:version |v)?2 0
lgpl-2.0|3|library|(?:gnu )?library general public license(?: as published by the free software foundation)?(?: either)? version 2
lgpl-2.1|3|lgpl|(?:gnu )?lgpl (?:version |v)?2 1(?: only| or later)?
lgpl-2.1|3|lgplv2|lgplv2(?: 1)?
lgpl-2.1|3|lesser|(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-2.1|3|lgpl|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|3|lgpl|(?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-3.0|3|lgplv3|lgplv3
lgpl-3.0|3|lesser|(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-3.0|3|lgpl|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl|2|lesser|you should have received a copy of the gnu lesser general public license
agpl|2|affero|(?:gnu )?affero general public license
agpl|3|agpl|licensed under (?:the )?(?:gnu )?agpl
agpl|3|agpl|(?:gnu )?agpl license
agpl-1.0|3|affero|affero general public license version 1
agpl-3.0|3|agpl|(?:gnu )?agpl (?:version |v)?3(?: 0)?(?: only| or later)?
agpl-3.0|3|agplv3|agplv3
agpl-3.0|3|affero|(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl-3.0|3|agpl|spdx license identifier agpl 3 0(?: only| or later)?
gfdl|2|gnu|gnu free documentation license
gfdl|3|gfdl|(?:gnu )?gfdl(?: license)?
gfdl-1.2|3|documentation|(?:gnu )?free documentation license version 1 2
gfdl-1.3|3|documentation|(?:gnu )?free documentation license version 1 3
bsd|2|bsd|bsd license
bsd|2|bsd|bsd style license
bsd|3|bsd|licensed under (?:the )?(?:terms of the )?bsd
bsd|3|bsd|released under (?:the )?bsd
bsd|2|berkeley|berkeley software distribution
bsd|2|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|2|redistributions|redistributions of source code must retain the above copyright notice
bsd|2|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd|2|holders|this software is provided by the copyright holders and contributors as is
bsd|2|regents|the regents of the university of california
bsd-1-clause|3|bsd|bsd 1 clause(?: license)?
bsd-2-clause|3|bsd|bsd 2 clause(?: license)?
bsd-2-clause|3|bsd|(?:the )?simplified bsd license
bsd-2-clause|3|bsd|(?:the )?freebsd license
bsd-2-clause|3|clause|(?:the )?two clause bsd license
bsd-3-clause|3|bsd|bsd 3 clause(?: license)?
bsd-3-clause|3|bsd|(?:the )?(?:new|revised|modified) bsd license
bsd-3-clause|3|clause|(?:the )?three clause bsd license
bsd-3-clause|2|endorse|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|3|bsd|bsd 4 clause(?: license)?
bsd-4-clause|3|bsd|(?:the )?original bsd license
bsd-4-clause|2|advertising|all advertising materials mentioning features or use of this software must display
0bsd|3|0bsd|0bsd
0bsd|3|bsd|(?:zero clause|bsd zero clause) (?:bsd|license)
isc|3|isc|(?:the )?isc license
isc|3|isc|licensed under (?:the )?isc
isc|2|purpose|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|3|isc|spdx license identifier isc
mpl|2|mozilla|mozilla public license
mpl-1.0|3|mozilla|mozilla public license(?: version)? 1 0
mpl-1.1|3|mozilla|mozilla public license(?: version)? 1 1
mpl-2.0|3|mozilla|mozilla public license(?: version| v)? 2 0
mpl-1.1|3|mpl|mpl (?:version |v)?1 1
mpl-2.0|3|mpl|mpl (?:version |v)?2 0
mpl-2.0|2|mozilla|this source code form is subject to the terms of the mozilla public license
npl|3|netscape|netscape public license
epl|2|eclipse|eclipse public license
epl-1.0|3|eclipse|eclipse public license(?: version| v)? 1 0
epl-2.0|3|eclipse|eclipse public license(?: version| v)? 2 0
epl-1.0|3|epl|epl (?:version |v)?1 0
epl-2.0|3|epl|epl (?:version |v)?2 0
edl-1.0|3|eclipse|eclipse distribution license(?: version| v)?(?: 1 0)?
eupl|2|european|european union public licen[cs]e
eupl-1.1|3|eupl|eupl (?:version |v)?1 1
eupl-1.2|3|eupl|eupl (?:version |v)?1 2
cddl|2|development|common development and distribution license
cddl-1.0|3|cddl|cddl (?:version |v)?1 0
cddl-1.1|3|cddl|cddl (?:version |v)?1 1
cddl-1.0|3|development|common development and distribution license(?: cddl)? version 1 0
cpl-1.0|3|common|common public license(?: version| v)?(?: 1 0)?
ipl-1.0|3|ibm|ibm public license(?: version| v)?(?: 1 0)?
cecill|2|cecill|cecill(?: free software)? licen[cs]e
cecill-2.1|3|cecill|cecill (?:version |v)?2 1
cecill-b|3|cecill|cecill b
cecill-c|3|cecill|cecill c
unlicense|3|unlicense|(?:the )?unlicense
unlicense|2|unencumbered|this is free and unencumbered software released into the public domain
unlicense|2|dedicate|the author or authors of this software dedicate any and all copyright interest
wtfpl|3|wtfpl|wtfpl(?: license)?
wtfpl|2|want|do what the \\S+ you want to public license
cc0|3|cc0|cc0(?: 1 0)?(?: universal)?
cc0|2|universal|creative commons zero(?: v1 0)? universal
cc0|2|waived|to the extent possible under law \\S+(?: \\S+)?(?: \\S+)? has waived all copyright
cc0|3|creativecommons|creativecommons org publicdomain zero 1 0
cc-pdm|3|creativecommons|creativecommons org publicdomain mark 1 0
cc|2|creative|creative commons license
cc|2|creative|creative commons attribution
cc-by|3|creative|creative commons attribution(?: license)?(?: version)? [1-4] [05]
cc-by|3|cc|cc by(?: [1-4] [05])?
cc-by-2.0|3|creativecommons|creativecommons org licenses by 2 0
cc-by-3.0|3|creativecommons|creativecommons org licenses by 3 0
cc-by-4.0|3|creativecommons|creativecommons org licenses by 4 0
cc-by-4.0|3|creative|creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0|3|creative|creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa|3|sharealike|creative commons attribution sharealike(?: [1-4] [05])?
cc-by-sa|3|share|creative commons attribution share alike(?: [1-4] [05])?
cc-by-sa|3|cc|cc by sa(?: [1-4] [05])?
cc-by-sa-3.0|3|creativecommons|creativecommons org licenses by sa 3 0
cc-by-sa-4.0|3|creativecommons|creativecommons org licenses by sa 4 0
cc-by-nc|3|noncommercial|creative commons attribution noncommercial(?: [1-4] [05])?
cc-by-nc|3|commercial|creative commons attribution non commercial(?: [1-4] [05])?
cc-by-nc|3|cc|cc by nc(?: [1-4] [05])?
cc-by-nc-4.0|3|creativecommons|creativecommons org licenses by nc 4 0
cc-by-nc-sa|3|noncommercial|creative commons attribution noncommercial sharealike(?: [1-4] [05])?
cc-by-nc-sa|3|cc|cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa-4.0|3|creativecommons|creativecommons org licenses by nc sa 4 0
cc-by-nd|3|creative|creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nd|3|noderivatives|creative commons attribution noderivatives(?: [1-4] [05])?
cc-by-nd|3|cc|cc by nd(?: [1-4] [05])?
cc-by-nd-4.0|3|creativecommons|creativecommons org licenses by nd 4 0
cc-by-nc-nd|3|noncommercial|creative commons attribution noncommercial no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nc-nd|3|cc|cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd-4.0|3|creativecommons|creativecommons org licenses by nc nd 4 0
public-domain|2|domain|(?:is )?in the public domain
public-domain|2|domain|dedicated to the public domain
public-domain|2|domain|released (?:in)?to the public domain
public-domain|2|domain|public domain dedication
pddl-1.0|3|pddl|pddl(?: 1 0)?
pddl-1.0|3|domain|public domain dedication and license
odbl-1.0|3|odbl|odbl(?: 1 0)?
odbl-1.0|3|database|open (?:data commons )?open database license
odc-by-1.0|3|commons|open data commons attribution license
zlib|3|zlib|(?:the )?zlib(?: libpng)? license
zlib|2|misrepresented|the origin of this software must not be misrepresented
zlib|2|altered|altered source versions must be plainly marked as such
libpng|3|libpng|(?:the )?libpng license
boost|3|boost|boost software license(?: version| v)?(?: 1 0)?
boost|3|bsl|bsl 1 0
busl-1.1|3|business|business source license(?: 1 1)?
busl-1.1|3|busl|busl 1 1
sspl-1.0|3|server|server side public license(?: version| v)?(?: 1)?
sspl-1.0|3|sspl|sspl(?: 1 0| v1)?
elastic-2.0|3|elastic|elastic license(?: version| v)?(?: 2 0)?
commons-clause|3|commons|commons clause(?: license condition)?
polyform|3|polyform|polyform (?:noncommercial|small business|shield|strict|perimeter|free trial)(?: license)?
artistic|2|artistic|(?:the )?artistic license
artistic-1.0|3|artistic|artistic license(?: version| v)? 1 0
artistic-2.0|3|artistic|artistic license(?: version| v)? 2 0
perl|2|perl|under the same terms as perl itself
ruby|3|ruby|(?:the )?ruby license
php-3.01|3|php|php license(?: version| v)?(?: 3 01?)?
psf-2.0|3|python|python software foundation license(?: version| v)?(?: 2)?
psf-2.0|3|psf|psf license(?: agreement)?
python-2.0|3|python|python license(?: 2 0)?
postgresql|3|postgresql|(?:the )?postgresql license
openssl|3|openssl|openssl license
openssl|2|openssl|this product includes software developed by the openssl project
ssleay|3|ssleay|ssleay license
ofl-1.1|3|sil|sil open font license(?: version| v)?(?: 1 1)?
ofl-1.1|3|ofl|ofl 1 1
ofl-1.1|2|reserved|reserved font name
ncsa|3|ncsa|(?:university of illinois )?ncsa(?: open source)? license
upl-1.0|3|universal|universal permissive license(?: version| v)?(?: 1 0)?
upl-1.0|3|upl|upl 1 0
bsl|2|boost|distributed under the boost software license
ms-pl|3|microsoft|microsoft public license
ms-pl|3|ms|ms pl
ms-rl|3|microsoft|microsoft reciprocal license
apsl-2.0|3|apple|apple public source license(?: version| v)?(?: 2 0)?
afl-3.0|3|academic|academic free license(?: version| v)?(?: 3 0)?
osl-3.0|3|open|open software license(?: version| v)?(?: 3 0)?
ecl-2.0|3|educational|educational community license(?: version| v)?(?: 2 0)?
rpl-1.5|3|reciprocal|reciprocal public license(?: 1 5)?
qpl-1.0|3|public|(?:the )?q public license(?: version| v)?(?: 1 0)?
sleepycat|3|sleepycat|sleepycat license
vim|3|vim|(?:the )?vim license
w3c|3|w3c|w3c (?:software|document)(?: notice and)? license
curl|3|curl|(?:the )?curl license
icu|3|icu|(?:the )?icu license
unicode|3|unicode|unicode (?:license|terms of use)
beerware|3|beer|beer ?ware license
beerware|2|beer|you can buy me a beer in return
json|2|evil|the software shall be used for good not evil
blueoak-1.0.0|3|oak|blue oak model license(?: 1 0 0)?
mulan-psl-2.0|3|mulan|mulan psl v2
mulan-psl-2.0|3|mulan|mulan permissive software license
zpl-2.1|3|zope|zope public license(?: version| v)?(?: 2 1)?
fsl|3|functional|functional source license
openrail|3|rail|(?:creativeml )?open ?rail(?: m)?(?: license)?
llama|3|llama|llama 2 community license
hippocratic|3|hippocratic|hippocratic license
proprietary|2|confidential|proprietary and confidential
proprietary|2|unauthorized|unauthorized copying of this file
rights-reserved|1|reserved|all rights reserved
rights-reserved|1|reserved|some rights reserved
copyright|1|copyright|copyright(?: c)? (?:19|20)[0-9][0-9]
warranty|1|warranty|without warranty of any kind
warranty|1|warranty|provided as is without warranty
licensed|1|licensed|licensed under the
licensed|1|license|see (?:the )?license(?: file)?
licensed|1|license|for license information
licensed|1|spdx|spdx license identifier
"""


#: By label and keyword: words one of which is in each match that has not the keyword as a word.
JOINED = {
    ("gpl-2.0", "gpl"): ("gpl2", "gplv2", "gplversion"),
    ("gpl-3.0", "gpl"): ("gpl3", "gplv3", "gplversion"),
    ("bsd-2-clause", "bsd"): ("freebsd",),
    ("0bsd", "bsd"): ("zero",),
    ("beerware", "beer"): ("beerware",),
    ("openrail", "rail"): ("openrail",),
}


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split("|", 3)
        out.append((label, int(priority), keyword, pattern))
    return out

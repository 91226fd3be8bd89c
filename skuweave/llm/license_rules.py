"""The rules of the license scan, written by hand: tier; confidence; label; regex; versions.

Regexes run over words: lower case, single spaces, no punctuation. A rule with versions stands for one rule for each of them;
{v} is the version, with dots in the label and spaces in the regex. Tier 1 names a license and its version or is a sentence of
its text, tier 2 names a license, tier 3 is a hint.
"""

from __future__ import annotations

RULES = r"""
1; .97; gpl-{v}; (?:gnu )?general public licen[cs]e (?:version |v )?{v}(?: 0)?; 1,2,3
1; .97; gpl-{v}; (?:gnu )?general public licen[cs]e as published by the free software foundation (?:either )?version {v}(?: 0)?; 1,2,3
1; .97; gpl-{v}-later; (?:gnu )?general public licen[cs]e (?:version |v )?{v}(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?; 1,2,3
1; .97; gpl-{v}-later; (?:gnu )?general public licen[cs]e as published by the free software foundation (?:either )?version {v}(?: 0)?(?: of the license)? or at your option any later version; 1,2,3
1; .97; gpl-{v}-only; (?:gnu )?general public licen[cs]e (?:version |v )?{v}(?: 0)? only; 1,2,3
1; .90; gpl-{v}; (?:gnu )?gpl ?(?:version |v ?)?{v}(?: 0)?; 1,2,3
1; .90; gpl-{v}-later; (?:gnu )?gpl ?(?:version |v ?)?{v}(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?; 1,2,3
1; .90; gpl-{v}-only; (?:gnu )?gpl ?(?:version |v ?)?{v}(?: 0)? only; 1,2,3
2; .80; gpl; (?:gnu )?general public licen[cs]e
2; .75; gpl; gnu gpl
2; .75; gpl; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?gpl
1; .99; gpl; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1; .95; gpl; you should have received a copy of the gnu general public license along with this program
1; .95; gpl; this program is distributed in the hope that it will be useful but without any warranty
1; .90; gpl; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
2; .80; gpl-exception; (?:gpl|general public license) with (?:the )?(?:classpath|linking|runtime library|font|bison|autoconf) exception
2; .80; gpl; gnu org (?:licenses|copyleft)(?: old licenses)?(?: gpl)?(?: html| txt)?
1; .97; lgpl-{v}; (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version |v )?{v}; 2,2.1,3
1; .97; lgpl-{v}-later; (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version |v )?{v} or (?:at your option )?(?:any )?later(?: version)?; 2,2.1,3
1; .97; lgpl-{v}-only; (?:gnu )?(?:lesser|library) general public licen[cs]e (?:version |v )?{v} only; 2,2.1,3
1; .90; lgpl-{v}; (?:gnu )?lgpl ?(?:version |v ?)?{v}; 2,2.1,3
1; .90; lgpl-{v}-later; (?:gnu )?lgpl ?(?:version |v ?)?{v} or (?:at your option )?(?:any )?later(?: version)?; 2,2.1,3
1; .90; lgpl-{v}-only; (?:gnu )?lgpl ?(?:version |v ?)?{v} only; 2,2.1,3
2; .80; lgpl; (?:gnu )?(?:lesser|library) general public licen[cs]e
2; .75; lgpl; gnu lgpl|(?:licensed|released|distributed) under (?:the )?lgpl
1; .99; lgpl; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
1; .97; agpl-{v}; (?:gnu )?affero general public licen[cs]e (?:version |v )?{v}(?: 0)?; 1,3
1; .97; agpl-{v}-later; (?:gnu )?affero general public licen[cs]e (?:version |v )?{v}(?: 0)? or (?:at your option )?(?:any )?later(?: version)?; 1,3
1; .90; agpl-{v}; (?:gnu )?agpl ?(?:version |v ?)?{v}(?: 0)?; 1,3
1; .90; agpl-{v}-later; (?:gnu )?agpl ?(?:version |v ?)?{v}(?: 0)? or (?:at your option )?(?:any )?later(?: version)?; 1,3
2; .80; agpl; (?:gnu )?affero general public licen[cs]e|gnu agpl
1; .97; fdl-{v}; (?:gnu )?free documentation licen[cs]e (?:version |v )?{v}; 1.1,1.2,1.3
1; .97; fdl-{v}-later; (?:gnu )?free documentation licen[cs]e (?:version |v )?{v} or (?:at your option )?(?:any )?later(?: version)?; 1.1,1.2,1.3
1; .90; fdl-{v}; (?:gnu )?g?fdl ?(?:version |v ?)?{v}; 1.1,1.2,1.3
2; .80; fdl; (?:gnu )?free documentation licen[cs]e|gnu g?fdl
1; .95; fdl; with no invariant sections no front cover texts and no back cover texts
1; .97; apache-{v}; apache (?:software )?licen[cs]e (?:version |v )?{v}; 1.0,1.1,2.0
1; .90; apache-{v}; apache (?:version |v ?|license )?{v}; 1.0,1.1,2.0
2; .70; apache-{v}; asl ?(?:version |v ?)?{v}|apl ?v?{v}; 1.1,2.0
2; .85; apache; apache (?:software )?licen[cs]e
1; .99; apache-2.0; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1; .90; apache-2.0; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
1; .95; apache-2.0; apache org licenses license 2 0(?: txt| html)?
1; .95; apache; this product includes software developed by the apache software foundation
2; .85; mit; (?:mit|expat) licen[cs]e
2; .80; mit; licen[cs]ed? (?:under )?(?:the )?mit
2; .80; mit; opensource org licenses mit(?: license)?(?: php| html)?
1; .99; mit; permission is hereby granted free of charge to any person obtaining a copy of this software
1; .95; mit; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1; .90; mit; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
1; .95; mit-0; mit no attribution(?: license)?|mit 0 license
2; .80; x11; x11 licen[cs]e|x consortium license
1; .95; x11; except as contained in this notice the name of the x consortium shall not be used in advertising
1; .99; isc; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2; .85; isc; isc licen[cs]e|internet (?:systems|software) consortium license
1; .95; hpnd; permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
1; .90; 0bsd; 0 ?bsd(?: license)?|zero clause bsd(?: license)?|bsd zero clause(?: license)?
1; .90; bsd-1; bsd 1 clause(?: license)?|1 clause bsd(?: license)?
1; .90; bsd-2; (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd (?:2|two) clause(?: license)?|freebsd license
1; .90; bsd-3; (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd (?:3|three) clause(?: license)?
1; .90; bsd-4; (?:original|old|4 clause|four clause) bsd licen[cs]e|bsd (?:4|four) clause(?: license)?
2; .85; bsd; bsd(?: style| like| type)? licen[cs]e
2; .75; bsd; (?:licensed|released|distributed) under (?:the )?bsd
1; .95; bsd; redistribution and use in source and binary forms with or without modification are permitted
1; .95; bsd; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1; .95; bsd; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
1; .95; bsd-3; neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products
1; .95; bsd-4; all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
1; .90; bsd; this software is provided by (?:[^ ]+ ){1,12}as is and any express or implied warranties
2; .85; bsd-patent; bsd (?:2 clause )?plus patent(?: license)?
1; .95; cc-by-{v}; cc by {v}; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-sa-{v}; cc by sa {v}; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-{v}; cc by nc {v}; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nd-{v}; cc by nd {v}; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-sa-{v}; cc by nc sa {v}; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-nd-{v}; cc by nc nd {v}; 1.0,2.0,2.5,3.0,4.0
2; .85; cc-by; cc by
2; .85; cc-by-sa; cc by sa
2; .85; cc-by-nc; cc by nc
2; .85; cc-by-nd; cc by nd
2; .85; cc-by-nc-sa; cc by nc sa
2; .85; cc-by-nc-nd; cc by nc nd
1; .95; cc-by-{v}; creative commons attribution {v}(?: international| unported| generic| [a-z]+)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-sa-{v}; creative commons attribution share ?alike {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-{v}; creative commons attribution non ?commercial {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nd-{v}; creative commons attribution no ?deriv(?:ative)?s {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-sa-{v}; creative commons attribution non ?commercial share ?alike {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
1; .95; cc-by-nc-nd-{v}; creative commons attribution non ?commercial no ?deriv(?:ative)?s {v}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?; 1.0,2.0,2.5,3.0,4.0
2; .85; cc-by; creative commons attribution(?: public)? licen[cs]e
2; .85; cc-by-sa; creative commons attribution share ?alike(?: public)?(?: licen[cs]e)?
2; .85; cc-by-nc; creative commons attribution non ?commercial(?: public)?(?: licen[cs]e)?
2; .85; cc-by-nd; creative commons attribution no ?deriv(?:ative)?s(?: public)?(?: licen[cs]e)?
2; .85; cc-by-nc-sa; creative commons attribution non ?commercial share ?alike(?: public)?(?: licen[cs]e)?
2; .85; cc-by-nc-nd; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: public)?(?: licen[cs]e)?
1; .90; cc-by-{v}; creativecommons org licenses by {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
1; .90; cc-by-sa-{v}; creativecommons org licenses by sa {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
1; .90; cc-by-nc-{v}; creativecommons org licenses by nc {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
1; .90; cc-by-nd-{v}; creativecommons org licenses by nd {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
1; .90; cc-by-nc-sa-{v}; creativecommons org licenses by nc sa {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
1; .90; cc-by-nc-nd-{v}; creativecommons org licenses by nc nd {v}(?: legalcode| deed [a-z]+)?; 1.0,2.0,2.5,3.0,4.0
2; .80; cc; creativecommons org licenses [^ ]+(?: [^ ]+)?
3; .50; cc; creative commons(?: licen[cs]e| lizenz)?
1; .95; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
1; .95; cc0; creative commons zero(?: 1 0)?(?: universal)?
1; .90; cc0; creativecommons org publicdomain zero(?: 1 0)?
2; .80; cc-pdm; creativecommons org publicdomain mark(?: 1 0)?|public domain mark 1 0
1; .97; mpl-{v}; mozilla public licen[cs]e (?:version |v )?{v}; 1.0,1.1,2.0
1; .90; mpl-{v}; mpl ?(?:version |v ?)?{v}; 1.0,1.1,2.0
2; .85; mpl; mozilla public licen[cs]e
2; .80; mpl; mozilla org mpl(?: mpl)?(?: 1 1| 2 0)?
1; .99; mpl-2.0; this source code form is subject to the terms of the mozilla public license v 2 0
1; .95; mpl-1.1; the contents of this file are subject to the mozilla public license version 1 1
1; .97; epl-{v}; eclipse public licen[cs]e (?:version |v )?{v}; 1.0,2.0
1; .90; epl-{v}; epl ?(?:version |v ?)?{v}; 1.0,2.0
2; .85; epl; eclipse public licen[cs]e
2; .80; epl; eclipse org legal epl(?: v10| v20| 2 0)?
1; .90; edl-1.0; eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
1; .97; eupl-{v}; european union public licen[cs]e (?:version |v )?{v}; 1.0,1.1,1.2
1; .90; eupl-{v}; eupl ?(?:version |v ?)?{v}; 1.0,1.1,1.2
2; .85; eupl; european union public licen[cs]e
1; .97; cddl-{v}; common development and distribution licen[cs]e (?:version |v )?{v}; 1.0,1.1
1; .90; cddl-{v}; cddl ?(?:version |v ?)?{v}; 1.0,1.1
2; .85; cddl; common development and distribution licen[cs]e
1; .90; cpl-1.0; common public licen[cs]e (?:version |v ?)?1 0|cpl ?(?:version |v ?)?1 0
2; .85; cpl; common public licen[cs]e
1; .90; ipl-1.0; ibm public licen[cs]e (?:version |v ?)?1 0
1; .97; artistic-{v}; artistic licen[cs]e (?:version |v )?{v}|artistic {v}; 1.0,2.0
2; .85; artistic; (?:perl |clarified )?artistic licen[cs]e
2; .80; perl; (?:same )?terms as perl(?: 5)? itself
1; .97; boost-1.0; boost software licen[cs]e (?:version |v )?1 0
2; .85; boost; boost software licen[cs]e
2; .70; boost-1.0; bsl ?v?1 0
1; .97; busl-1.1; business source licen[cs]e(?: (?:version |v )?1 1)?
2; .80; busl-1.1; busl ?v?1 1|bsl ?v?1 1
1; .97; ofl-{v}; (?:sil )?open font licen[cs]e (?:version |v )?{v}; 1.0,1.1
2; .85; ofl; (?:sil )?open font licen[cs]e
2; .75; ofl-{v}; ofl ?v?{v}; 1.0,1.1
1; .97; php-{v}; php licen[cs]e (?:version |v )?{v}; 3.0,3.01
2; .85; php; php licen[cs]e
1; .97; osl-{v}; open software licen[cs]e (?:version |v )?{v}; 1.0,2.0,2.1,3.0
2; .75; osl-{v}; osl ?v?{v}; 1.0,2.0,2.1,3.0
2; .85; osl; open software licen[cs]e
1; .97; afl-{v}; academic free licen[cs]e (?:version |v )?{v}; 1.1,2.0,2.1,3.0
2; .75; afl-{v}; afl ?v?{v}; 1.1,2.0,2.1,3.0
2; .85; afl; academic free licen[cs]e
1; .97; cecill-{v}; cecill(?: free software)?(?: licen[cs]e)?(?: agreement)? (?:version |v )?{v}; 1.0,2.0,2.1
2; .85; cecill; cecill (?:[bc] )?(?:free software )?licen[cs]e|licence cecill(?: [bc])?
1; .97; zpl-{v}; zope public licen[cs]e (?:version |v )?{v}|zpl ?v?{v}; 1.1,2.0,2.1
2; .85; zpl; zope public licen[cs]e
1; .90; odbl-1.0; (?:open data commons )?open database licen[cs]e (?:version |v )?1 0|odbl ?v?1 0
2; .85; odbl; (?:open data commons )?open database licen[cs]e|opendatacommons org licenses odbl
1; .90; odc-by-1.0; open data commons attribution licen[cs]e (?:version |v )?1 0|odc by ?v?1 0
2; .85; odc-by; open data commons attribution licen[cs]e|opendatacommons org licenses by
1; .90; pddl-1.0; (?:open data commons )?public domain dedication and licen[cs]e (?:version |v )?1 0|pddl ?v?1 0
2; .85; pddl; (?:open data commons )?public domain dedication and licen[cs]e
1; .90; cdla-permissive-{v}; community data licen[cs]e agreement permissive (?:version |v )?{v}|cdla permissive {v}; 1.0,2.0
1; .90; cdla-sharing-1.0; community data licen[cs]e agreement sharing (?:version |v )?1 0|cdla sharing 1 0
1; .90; ogl-uk-{v}; open government licen[cs]e (?:version |v )?{v}|ogl uk {v}|ogl ?v{v}; 1.0,2.0,3.0
2; .85; ogl; open government licen[cs]e
1; .90; etalab-2.0; (?:etalab )?licence ouverte(?: open licen[cs]e)? (?:version |v )?2 0|etalab 2 0
2; .80; etalab; licence ouverte(?: open licen[cs]e)?
1; .90; dl-de-by-2.0; datenlizenz deutschland namensnennung (?:version )?2 0|dl de by 2 0
2; .80; dl-de; datenlizenz deutschland(?: namensnennung| zero)?
2; .85; ncsa; university of illinois (?:ncsa )?open source licen[cs]e|ncsa open source license
2; .85; ms-pl; microsoft public licen[cs]e|ms pl license
2; .85; ms-rl; microsoft reciprocal licen[cs]e|ms rl license
2; .85; zlib; zlib(?: libpng)? licen[cs]e
1; .95; zlib; this software is provided as is without any express or implied warranty in no event will the authors be held liable
1; .95; zlib; the origin of this software must not be misrepresented you must not claim that you wrote the original software
2; .85; libpng; libpng licen[cs]e(?: version 2)?
2; .85; wtfpl; do what the f[^ ]+ you want to public licen[cs]e|wtfpl(?: license)?
2; .85; unlicense; the unlicense|unlicense org
1; .95; unlicense; this is free and unencumbered software released into the public domain
2; .85; psf; python software foundation licen[cs]e|psf license
1; .90; psf-2; python software foundation licen[cs]e (?:version |v )?2|psf license (?:version |v )?2
2; .85; ruby; ruby licen[cs]e|same terms as ruby
2; .85; vim; vim licen[cs]e
2; .85; postgresql; postgresql licen[cs]e
2; .85; openssl; openssl licen[cs]e|openssl ssleay license
2; .85; curl; curl licen[cs]e
2; .85; json; the software shall be used for good not evil|json license
2; .80; beerware; beer ?ware licen[cs]e|buy me a beer in return
2; .85; tcl; tcl(?: tk)? licen[cs]e
2; .85; unicode; unicode licen[cs]e(?: v3)?|unicode terms of use
2; .85; w3c; w3c (?:software )?(?:notice and )?(?:document )?licen[cs]e
2; .85; icu; icu licen[cs]e
2; .85; ijg; independent jpeg group(?: license)?
2; .85; mulan-psl; mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?
2; .85; upl-1.0; universal permissive licen[cs]e(?: (?:version |v )?1 0)?
2; .85; apsl; apple public source licen[cs]e(?: (?:version |v )?(?:1|2) [0-9])?
2; .85; cpal-1.0; common public attribution licen[cs]e(?: (?:version |v )?1 0)?
2; .85; lppl; latex project public licen[cs]e(?: (?:version |v )?1 3[a-c]?)?
2; .85; lal; (?:free art licen[cs]e|licence art libre)(?: 1 [0-9])?
2; .85; opl; open (?:publication|content) licen[cs]e(?: (?:version |v )?1 0)?
2; .85; sspl-1.0; server side public licen[cs]e(?: (?:version |v )?1)?
2; .85; elastic-2.0; elastic licen[cs]e(?: (?:version |v )?2 0)?
2; .85; polyform; polyform (?:noncommercial|small business|shield|strict|internal use) licen[cs]e(?: 1 0 0)?
2; .80; commons-clause; commons clause(?: license condition)?
2; .80; openrail; (?:creativeml |bigscience )?(?:open ?rail(?: m)?|rail) licen[cs]e
2; .80; llama; llama (?:2|3|3 1|3 2) community licen[cs]e(?: agreement)?
2; .80; rpl-1.5; reciprocal public licen[cs]e(?: 1 [0-9])?
2; .80; qpl-1.0; q public licen[cs]e(?: (?:version |v )?1 0)?
2; .80; nasa-1.3; nasa open source agreement(?: (?:version |v )?1 3)?
2; .80; sleepycat; sleepycat licen[cs]e
2; .80; watcom; sybase open watcom public licen[cs]e
2; .80; bittorrent; bittorrent open source licen[cs]e
2; .80; gfdl-wiki; text is available under the creative commons [^ ]+(?: [^ ]+){0,4} licen[cs]e
1; .99; spdx; spdx licen[cs]e identifier [^ ]+(?: [0-9]+)?(?: [0-9]+)?(?: only| or later)?
1; .99; mit; spdx licen[cs]e identifier mit
1; .99; apache-2.0; spdx licen[cs]e identifier apache 2 0
1; .99; bsd-{v}; spdx licen[cs]e identifier bsd {v} clause; 2,3,4
1; .99; gpl-{v}-only; spdx licen[cs]e identifier gpl {v} 0(?: only)?; 2,3
1; .99; gpl-{v}-later; spdx licen[cs]e identifier gpl {v} 0 or later; 2,3
1; .99; mpl-2.0; spdx licen[cs]e identifier mpl 2 0
1; .99; isc; spdx licen[cs]e identifier isc
1; .90; public-domain; (?:dedicated|released|placed|put|donated) (?:in|in to|into|to) the public domain
2; .80; public-domain; (?:this|the) (?:work|file|document|text|software|book) is in the public domain
3; .50; public-domain; public domain
2; .80; proprietary; proprietary and confidential|confidential and proprietary
2; .80; proprietary; (?:strictly|company) confidential
2; .70; proprietary; (?:may|must|shall) not be (?:reproduced|copied|redistributed)(?: or [^ ]+)?(?: in any form)?
2; .80; proprietary; no part of this (?:publication|document|book|work|site) may be (?:reproduced|copied|stored)
2; .80; proprietary; unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or [^ ]+)? (?:of this (?:file|work|material) )?(?:is )?(?:strictly )?prohibited
2; .70; proprietary; end user licen[cs]e agreement|subject to (?:a|the|our) (?:commercial|proprietary) licen[cs]e
2; .60; non-commercial; (?:for )?non ?commercial (?:use|purposes) only|free for (?:personal|non ?commercial) use
2; .60; reserved; some rights reserved
2; .70; reserved; (?:alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|tutti i diritti riservati|todos os direitos reservados)(?: all rights reserved)?
3; .30; licensed; licen[cs]ed under(?: the)? [^ ]+
3; .30; licensed; (?:released|distributed|published|available) under (?:the|an?) [^ ]+(?: [^ ]+)? licen[cs]e
3; .30; licensed; under the terms of the [^ ]+(?: [^ ]+)? licen[cs]e
3; .30; licensed; see (?:the )?licen[cs]e(?: file| txt| md)? for (?:details|more information|licensing)
3; .30; licensed; open source licen[cs]e
3; .30; licensed; dual licen[cs]ed|licen[cs]e agreement
3; .40; copyright; copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})*
3; .40; copyright; copyrighted (?:material|work|content)
3; .40; copyright; (?:all )?(?:contents?|text|images?) copyright(?: of)? [^ ]+
3; .30; no-warranty; without (?:any )?warrant(?:y|ies) of any kind
3; .30; no-warranty; merchantability (?:or |and )?fitness for a particular purpose
3; .30; permission; (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission
"""


def rules() -> list[tuple[int, float, str, str]]:
    """(tier, confidence, label, regex) of each rule, versions filled in."""
    out = []
    for line in RULES.strip().splitlines():
        tier, confidence, label, regex, *versions = (x.strip() for x in line.split("; "))
        for v in versions[0].split(",") if versions else [""]:
            out.append((int(tier), float(confidence), label.replace("{v}", v), regex.replace("{v}", v.replace(".", " "))))
    return out

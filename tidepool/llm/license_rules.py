"""Signature rules of the license scan, in order: label | priority | keyword | pattern.

A pattern is matched against lower-cased words joined by single blanks, from a word's start to a word's end. Only texts
with the rule's keyword, or one of several parted by a slash, among their words are tried. Priority 3 names a license and its version or quotes it uniquely, 2 names a
license, 1 is a general notice.
"""

_TABLE = r"""
apache-2.0 | 3 | apache | apache license (?:version )?v?2(?: 0)?
apache-2.0 | 3 | apache | apache (?:software )?licen[cs]e v(?:ersion)? ?2(?: 0)?
apache-2.0 | 3 | apache | apache 2(?: 0)?(?: licen[cs]e)?
apache-2.0 | 3 | apache | (?:spdx license identifier )apache 2 0
apache-2.0 | 3 | apache | http www apache org licenses license 2 0
apache-1.1 | 3 | apache | apache (?:software )?license (?:version )?1 1
apache-1.0 | 3 | apache | apache (?:software )?license (?:version )?1 0
apache | 2 | apache | (?:licensed|released|distributed) under (?:the )?apache(?: software)? licen[cs]e
apache | 2 | apache | apache software foundation licen[cs]e
apache | 2 | apache | apache licen[cs]e
mit | 3 | mit | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit | 3 | mit | spdx license identifier mit
mit | 3 | mit | (?:the )?mit licen[cs]e(?: mit)?
mit | 2 | mit | mit licen[cs]ed
mit | 2 | mit | license mit
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 2 | permission | the above copyright notice and this permission notice shall be included
mit-0 | 3 | mit | (?:mit 0|mit no attribution)(?: licen[cs]e)?
x11 | 3 | x11 | x11 licen[cs]e
x11 | 3 | consortium | x consortium licen[cs]e
expat | 3 | expat | expat licen[cs]e
isc | 3 | isc | (?:the )?isc licen[cs]e
isc | 3 | isc | spdx license identifier isc
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose
gpl | 2 | general | general public licen[cs]e
gpl-2.0 | 3 | general | (?:gnu )?general public licen[cs]e (?:version |v)2(?: 0)?
gpl-3.0 | 3 | general | (?:gnu )?general public licen[cs]e (?:version |v)3(?: 0)?
gpl-1.0 | 3 | general | (?:gnu )?general public licen[cs]e (?:version |v)1(?: 0)?
gpl-2.0-or-later | 3 | general | general public licen[cs]e (?:[^ ]+ ){0,12}either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | 3 | general | general public licen[cs]e (?:[^ ]+ ){0,12}either version 3 of the license or (?:at your option )?any later version
gpl-2.0 | 3 | gpl/gplv2/gpl2 | gpl ?v?2(?: 0)?(?: only)?
gpl-3.0 | 3 | gpl/gplv3/gpl3 | gpl ?v?3(?: 0)?(?: only)?
gpl-2.0-or-later | 3 | gpl | gpl 2 0 or later
gpl-3.0-or-later | 3 | gpl | gpl 3 0 or later
gpl-2.0 | 3 | gplv2 | gplv2
gpl-3.0 | 3 | gplv3 | gplv3
gpl | 2 | gpl | (?:gnu )?gpl(?: licen[cs]ed?)?
gpl-classpath | 3 | classpath | (?:gpl )?(?:with )?(?:the )?classpath exception
gpl-linking | 3 | linking | (?:gpl )?linking exception
lgpl-2.0 | 3 | library | (?:gnu )?library general public licen[cs]e(?: (?:version |v)2(?: 0)?)?
lgpl-2.1 | 3 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)2 1
lgpl-3.0 | 3 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v)3(?: 0)?
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl-2.1 | 3 | lgpl/lgplv2/lgpl2 | lgpl ?v?2 1
lgpl-3.0 | 3 | lgpl/lgplv3/lgpl3 | lgpl ?v?3(?: 0)?
lgpl | 2 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 3 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v)3(?: 0)?
agpl-1.0 | 3 | affero | affero general public licen[cs]e (?:version |v)1(?: 0)?
agpl | 2 | affero | (?:gnu )?affero (?:general public|gpl)(?: licen[cs]e)?
agpl-3.0 | 3 | agpl/agplv3/agpl3 | agpl ?v?3(?: 0)?
agpl | 2 | agpl | (?:gnu )?agpl
gfdl-1.1 | 3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version )?1 1
gfdl-1.2 | 3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version )?1 2
gfdl-1.3 | 3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version )?1 3
gfdl | 2 | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | 2 | gfdl | (?:gnu )?gfdl
gnu-all-permissive | 3 | copying | copying and distribution of this file with or without modification are permitted
bsd-2-clause | 3 | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause | 3 | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | bsd 4 clause(?: licen[cs]e)?
bsd-1-clause | 3 | bsd | bsd 1 clause(?: licen[cs]e)?
0bsd | 3 | 0bsd | 0bsd(?: licen[cs]e)?
0bsd | 3 | zero/free | (?:zero clause|bsd zero clause|free public) (?:bsd )?licen[cs]e
bsd | 2 | bsd | bsd(?: style)? licen[cs]ed?
bsd | 2 | redistribution | redistribution and use in source and binary forms
bsd-3-clause | 2 | endorse | may (?:not )?be used to endorse or promote products
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software
bsd-patent | 3 | bsd | bsd (?:2 clause )?plus patent
bsd-protection | 3 | bsd | bsd protection licen[cs]e
mpl-1.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v)?1 0
mpl-1.1 | 3 | mozilla | mozilla public licen[cs]e (?:version |v)?1 1
mpl-2.0 | 3 | mozilla | mozilla public licen[cs]e (?:version |v)?2(?: 0)?
mpl-2.0 | 3 | mpl | mpl (?:v ?)?2(?: 0)?
mpl-1.1 | 3 | mpl | mpl (?:v ?)?1 1
mpl | 2 | mozilla | mozilla public licen[cs]e
npl | 3 | netscape | netscape public licen[cs]e
epl-1.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v)?1(?: 0)?
epl-2.0 | 3 | eclipse | eclipse public licen[cs]e (?:version |v)?2(?: 0)?
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 3 | eclipse | eclipse distribution licen[cs]e
cddl-1.0 | 3 | development | common development and distribution licen[cs]e (?:version )?1 0
cddl-1.1 | 3 | development | common development and distribution licen[cs]e (?:version )?1 1
cddl | 2 | development | common development and distribution licen[cs]e
cddl | 2 | cddl | cddl(?: 1 [01])?
cpl-1.0 | 3 | common | common public licen[cs]e(?: (?:version )?1 0)?
ipl-1.0 | 3 | ibm | ibm public licen[cs]e(?: (?:version )?1 0)?
cpal-1.0 | 3 | attribution | common public attribution licen[cs]e
osl-3.0 | 3 | open | open software licen[cs]e (?:version |v)?3(?: 0)?
osl | 2 | open | open software licen[cs]e
afl-3.0 | 3 | academic | academic free licen[cs]e (?:version |v)?3(?: 0)?
afl | 2 | academic | academic free licen[cs]e
ecl-2.0 | 3 | educational | educational community licen[cs]e(?: (?:version )?2(?: 0)?)?
eupl-1.1 | 3 | european | european union public licen[cs]e (?:version |v)?1 1
eupl-1.2 | 3 | european | european union public licen[cs]e (?:version |v)?1 2
eupl | 2 | european | european union public licen[cs]e
eupl | 2 | eupl | eupl(?: 1 [12])?
cecill | 2 | cecill | cecill(?: [bc])?(?: licen[cs]e| 2 [01])?
artistic-1.0 | 3 | artistic | artistic licen[cs]e (?:version )?1(?: 0)?
artistic-2.0 | 3 | artistic | artistic licen[cs]e (?:version )?2(?: 0)?
artistic | 2 | artistic | (?:the )?(?:clarified )?artistic licen[cs]e
perl | 2 | perl | same terms as perl(?: itself)?
python-2.0 | 3 | python | python software foundation licen[cs]e
python | 2 | python | python licen[cs]e(?: 2 0)?
psf | 2 | psf | psf licen[cs]e
ruby | 2 | ruby | ruby s? ?licen[cs]e
php-3.01 | 3 | php | php licen[cs]e (?:version )?3 01
php | 2 | php | php licen[cs]e
zend | 2 | zend | zend (?:engine )?licen[cs]e
zlib | 3 | zlib | zlib (?:libpng )?licen[cs]e
zlib | 3 | misrepresented | the origin of this software must not be misrepresented
zlib | 2 | provided | provided as is without any express or implied warranty in no event
libpng | 3 | libpng | libpng (?:2 0 )?licen[cs]e
openssl | 3 | openssl | openssl licen[cs]e
ssleay | 3 | ssleay | (?:original )?ssleay licen[cs]e
curl | 3 | curl | curl licen[cs]e
bzip2 | 3 | bzip2 | bzip2 licen[cs]e
boost-1.0 | 3 | boost | boost software licen[cs]e(?: version)?(?: 1 0)?
boost | 2 | boost | boost licen[cs]e
bsl-1.1 | 3 | business | business source licen[cs]e(?: (?:version )?1 1)?
sspl-1.0 | 3 | server | server side public licen[cs]e(?: (?:version )?1)?
elastic-2.0 | 3 | elastic | elastic licen[cs]e (?:version )?2(?: 0)?
elastic | 2 | elastic | elastic licen[cs]e
commons-clause | 3 | clause | commons clause(?: licen[cs]e condition)?
polyform | 2 | polyform | polyform (?:noncommercial|strict|shield|perimeter|small business|free trial)(?: licen[cs]e)?
confluent | 2 | confluent | confluent community licen[cs]e
timescale | 2 | timescale | timescale licen[cs]e
redis | 2 | redis | redis source available licen[cs]e
unlicense | 3 | unlicense | (?:the )?unlicense
unlicense | 3 | unencumbered | free and unencumbered software released into the public domain
public-domain | 2 | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 2 | domain | (?:is|are|in) (?:in )?the public domain
public-domain | 1 | domain | public domain
cc0-1.0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | creative | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
wtfpl | 3 | wtfpl | wtfpl
wtfpl | 3 | want | do what the f[^ ]* you want to public licen[cs]e
beerware | 3 | beer/beerware | beer ?ware licen[cs]e
beerware | 3 | beer | you can buy me a beer in return
cc-by | 2 | cc | cc by
cc-by-2.0 | 3 | cc | cc by 2 0
cc-by-2.5 | 3 | cc | cc by 2 5
cc-by-3.0 | 3 | cc | cc by 3 0
cc-by-4.0 | 3 | cc | cc by 4 0
cc-by-sa | 2 | cc | cc by sa
cc-by-sa-2.0 | 3 | cc | cc by sa 2 0
cc-by-sa-2.5 | 3 | cc | cc by sa 2 5
cc-by-sa-3.0 | 3 | cc | cc by sa 3 0
cc-by-sa-4.0 | 3 | cc | cc by sa 4 0
cc-by-nc | 2 | cc | cc by nc
cc-by-nc-2.0 | 3 | cc | cc by nc 2 0
cc-by-nc-3.0 | 3 | cc | cc by nc 3 0
cc-by-nc-4.0 | 3 | cc | cc by nc 4 0
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-sa-2.0 | 3 | cc | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 3 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 3 | cc | cc by nc sa 4 0
cc-by-nd | 2 | cc | cc by nd
cc-by-nd-3.0 | 3 | cc | cc by nd 3 0
cc-by-nd-4.0 | 3 | cc | cc by nd 4 0
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-nd-3.0 | 3 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 3 | cc | cc by nc nd 4 0
cc-by | 2 | creative | creative commons attribution(?: licen[cs]e)?
cc-by-3.0 | 3 | creative | creative commons attribution (?:licen[cs]e )?3 0(?: (?:unported|international))?(?: licen[cs]e)?
cc-by-4.0 | 3 | creative | creative commons attribution (?:licen[cs]e )?4 0(?: international)?(?: licen[cs]e)?
cc-by-sa | 2 | creative | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-sa-3.0 | 3 | creative | creative commons attribution share ?alike (?:licen[cs]e )?3 0(?: (?:unported|international))?(?: licen[cs]e)?
cc-by-sa-4.0 | 3 | creative | creative commons attribution share ?alike (?:licen[cs]e )?4 0(?: international)?(?: licen[cs]e)?
cc-by-nc | 2 | creative | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nc-4.0 | 3 | creative | creative commons attribution non ?commercial (?:licen[cs]e )?4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa | 2 | creative | creative commons attribution non ?commercial share ?alike(?: (?:3|4) 0)?
cc-by-nd | 2 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: (?:3|4) 0)?
cc-by-nc-nd | 2 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:3|4) 0)?
cc-by | 3 | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 3 | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 3 | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc-sa | 3 | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nd | 3 | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-nd | 3 | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0-1.0 | 3 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
public-domain-mark | 3 | creativecommons | creativecommons org publicdomain mark(?: 1 0)?
creative-commons | 1 | creative | creative commons(?: licen[cs]e)?
odbl-1.0 | 3 | database | open (?:data commons open )?database licen[cs]e(?: (?:version )?1 0)?
odbl-1.0 | 3 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 3 | commons | open data commons attribution licen[cs]e(?: 1 0)?
pddl-1.0 | 3 | dedication | public domain dedication (?:and|or) licen[cs]e(?: 1 0)?
ogl-uk | 3 | government | open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)?
ogl-ca | 3 | government | open government licen[cs]e canada
etalab-2.0 | 3 | etalab | etalab (?:2 0|open licen[cs]e)
dl-de-by | 3 | datenlizenz | datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?
ofl-1.1 | 3 | font | (?:sil )?open font licen[cs]e(?: (?:version )?1 [01])?
ofl-1.1 | 3 | ofl | (?:sil )?ofl(?: 1 [01])?
ipa-font | 3 | ipa | ipa font licen[cs]e
ubuntu-font | 3 | ubuntu | ubuntu font licen[cs]e
bitstream-vera | 3 | bitstream | bitstream vera(?: fonts?)? (?:copyright|licen[cs]e)
lppl-1.3c | 3 | latex | latex project public licen[cs]e(?: (?:version )?1 3c?)?
lppl | 2 | lppl | lppl(?: 1 3[ac]?)?
ms-pl | 3 | microsoft | microsoft public licen[cs]e
ms-rl | 3 | microsoft | microsoft reciprocal licen[cs]e
ms-pl | 3 | pl | ms pl
apsl-2.0 | 3 | apple | apple public source licen[cs]e(?: (?:version )?2(?: 0)?)?
intel | 2 | intel | intel open source licen[cs]e
nokia | 2 | nokia | nokia open source licen[cs]e
sun-spl | 2 | sun | sun public licen[cs]e
sissl | 2 | sun | sun industry standards source licen[cs]e
qpl-1.0 | 3 | q | q public licen[cs]e(?: (?:version )?1 0)?
w3c | 3 | w3c | w3c (?:software )?(?:notice and )?(?:document )?licen[cs]e
unicode | 3 | unicode | unicode (?:data files and software |inc |terms )?licen[cs]e(?: agreement)?
icu | 3 | icu | icu licen[cs]e
ncsa | 3 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
postgresql | 3 | postgresql | (?:the )?postgresql licen[cs]e
vim | 3 | vim | vim licen[cs]e
tcl | 3 | tcl | tcl tk licen[cs]e
sleepycat | 3 | sleepycat | sleepycat (?:public )?licen[cs]e
nasa-1.3 | 3 | nasa | nasa open source agreement(?: 1 3)?
ntp | 3 | ntp | ntp licen[cs]e
hpnd | 3 | historical | historical permission notice and disclaimer
watcom | 3 | watcom | sybase open watcom public licen[cs]e
upl-1.0 | 3 | permissive | universal permissive licen[cs]e(?: (?:version |v)?1 0)?
mulan-2.0 | 3 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: (?:version |v)?[12])?
blueoak-1.0.0 | 3 | oak | blue oak model licen[cs]e(?: 1 0 0)?
hippocratic | 3 | hippocratic | hippocratic licen[cs]e(?: [12] [01])?
parity | 3 | parity | parity public licen[cs]e
cua-opl | 3 | cua | cua office public licen[cs]e
rpl-1.5 | 3 | reciprocal | reciprocal public licen[cs]e(?: 1 5)?
openrail | 3 | rail/openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
llama-community | 3 | llama | llama (?:[234] )?(?:[0-9] )?community licen[cs]e(?: agreement)?
gemma-terms | 3 | gemma | gemma terms of use
free-art-1.3 | 3 | art | free art licen[cs]e(?: 1 3)?
opl-1.0 | 3 | publication | open publication licen[cs]e(?: (?:version |v)?1 0)?
spdx | 2 | spdx | spdx license identifier [^ ]+(?: [0-9]+(?: [0-9]+)?)?
reserved | 2 | reserved | all rights reserved
some-reserved | 2 | reserved | some rights reserved
no-reserved | 2 | reserved | no rights reserved
alle-rechte | 2 | rechte | alle rechte vorbehalten
tous-droits | 2 | droits | tous droits réservés
todos-derechos | 2 | derechos | todos los derechos reservados
copyright | 1 | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?(?: by)?
copyright | 1 | copyrighted | copyrighted (?:material|by|work)
copyleft | 1 | copyleft | copyleft
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 2 | proprietary | (?:this is )?proprietary software
non-commercial | 1 | commercial/noncommercial | for (?:personal and )?non ?commercial use only
evaluation | 1 | evaluation | for evaluation (?:purposes )?only
no-redistribution | 2 | redistributed | may not be (?:copied |reproduced )?(?:or )?redistributed
no-reproduction | 2 | reproduced | (?:may not|no part of [^ ]+ [^ ]+ may) be reproduced
written-permission | 1 | permission | without (?:the )?(?:prior )?(?:express )?written permission
as-is | 1 | provided | provided (?:by [^ ]+ [^ ]+ )?as is
no-warranty | 1 | warranty/warranties | without (?:any )?warrant(?:y|ies)(?: of any kind)?
no-warranty | 1 | warranty | absolutely no warranty
free-software | 1 | software | this (?:program|library|file) is free software
open-source | 1 | source | open source licen[cs]ed?
dual | 1 | dual | dual licen[cs]ed
see-license | 1 | license | see (?:the )?license(?: file)?(?: for (?:more )?(?:details|information))?
licensed-under | 1 | licensed | (?:is )?licensed under (?:the )?(?:terms|conditions)
release-under | 1 | released | released under (?:the )?(?:terms|conditions)
"""


def _rows() -> list[tuple[str, int, str, str]]:
    out = []
    for line in _TABLE.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((label, int(priority), keyword, pattern))
    return out


RULES = _rows()
#: Phrases whose every place counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

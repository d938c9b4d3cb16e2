"""License scans by ordered signature rules.

A text is lower-cased and its words are put one space apart. Each rule is a regular expression over these words, written by hand, with
its optional and alternative parts, and gated by a keyword: a rule runs only over texts that have its keyword. Rules are ordered by priority:
notices and identifiers, addresses, full names, tags, and last names that only tell a group. A detection that lies within an interval
found by a rule of higher priority, or found before by the same priority, is suppressed, so one notice gives one label; the base
phrases are always reported beside these.

One narrow Python stage, no shuffle.

Defined cases: null or empty text: no words, no labels, score 0; very long texts: linear passes, one text at a time; repeated
rows and extra columns don't matter; empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Shorthands of the rules below: "~" an optional word for a version and a space, "%" license or licence, "@" an optional "or later" and its like,
#: "^" how a text says that it is under a license.
SHORT = {
    "~": r"(?: version| ver| v|v)? ?",
    "%": r"licen[cs]e",
    "@": r"(?: only| or (?:\(?at your option\)? )?(?:any )?(?:later|newer)(?: version)?)?",
    "^": r"(?<!not )(?:licen[cs]ed|released|distributed|available|provided|published|covered|offered|made available|redistribut\w+|is) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?",
}
#: label, gating keyword (_ is a space), priority, expression.
RULES = r"""
agpl-3.0 affero 1 ^(?:gnu )?affero general public %~3(?: 0)?@
agpl-3.0 affero 3 (?:gnu )?affero (?:general public %|gpl)~3(?: 0)?@
agpl-3.0 agpl 1 spdx % identifier agpl 3 0@
agpl-3.0 agpl 1 ^(?:gnu )?agpl~3(?: 0)?@
agpl-3.0 agpl 4 (?:gnu )?agpl~3(?: 0)?@
agpl-3.0 agpl 2 gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
agpl-any affero 5 (?:gnu )?affero (?:general public %|gpl)
agpl-any agpl 5 (?:gnu )?agpl(?:ed)?
gpl-1.0 general_public 3 (?:gnu )?general public %~1(?: 0)?@
gpl-1.0 gpl 4 gpl~1(?: 0)?(?! \d)@
gpl-2.0 general_public 1 ^(?:gnu )?general public %(?: as published by the free software foundation)?(?: either)?~2(?: 0)?@
gpl-2.0 general_public 3 (?:gnu )?general public %(?: as published by the free software foundation)?(?: either)?~2(?: 0)?@
gpl-2.0 gpl 1 spdx % identifier gpl 2 0@
gpl-2.0 gpl 1 ^(?:gnu )?gpl~2(?: 0)?@
gpl-2.0 gpl 4 (?:gnu )?gpl~2(?: 0)?@
gpl-2.0 gnu_org 2 gnu org (?:copyleft|licenses(?: old licenses)?) gpl 2 0(?: en)?(?: html| txt)?
gpl-2.0 51_franklin 3 free software foundation inc 51 franklin (?:st(?:reet)? )?(?:fifth|5th) floor boston
gpl-3.0 general_public 1 ^(?:gnu )?general public %(?: as published by the free software foundation)?(?: either)?~3(?: 0)?@
gpl-3.0 general_public 3 (?:gnu )?general public %(?: as published by the free software foundation)?(?: either)?~3(?: 0)?@
gpl-3.0 gpl 1 spdx % identifier gpl 3 0@
gpl-3.0 gpl 1 ^(?:gnu )?gpl~3(?: 0)?@
gpl-3.0 gpl 4 (?:gnu )?gpl~3(?: 0)?@
gpl-3.0 gnu_org 2 gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-any general_public 5 (?:gnu )?general public %
gpl-any gnu_org 5 gnu org (?:copyleft|licenses) gpl(?: html| txt)?
gpl-any gpl 5 (?:gnu|the|under) gpl(?:ed)?
gpl-any gpl 5 gpl (?:%d?|compatible|code|software|program|notice)
gpl-any free_software 1 this program is free software(?: you can redistribute it and or modify it)?
gpl-exception classpath 3 (?:gnu )?(?:gpl )?(?:with (?:the )?)?classpath (?:linking )?exception
gpl-exception linking 3 (?:gpl|general public %) (?:with )?(?:a )?(?:special )?linking exception
lgpl-2.0 library 3 (?:gnu )?library general public %~2(?: 0)?@
lgpl-2.1 lesser 1 ^(?:gnu )?lesser general public %(?: as published by the free software foundation)?(?: either)?~2 1@
lgpl-2.1 lesser 3 (?:gnu )?lesser general public %(?: as published by the free software foundation)?(?: either)?~2 1@
lgpl-2.1 lgpl 1 spdx % identifier lgpl 2 1@
lgpl-2.1 lgpl 4 (?:gnu )?lgpl~2 1@
lgpl-2.1 gnu_org 2 gnu org licenses(?: old licenses)? lgpl 2 1(?: en)?(?: html| txt)?
lgpl-3.0 lesser 1 ^(?:gnu )?lesser general public %(?: as published by the free software foundation)?(?: either)?~3(?: 0)?@
lgpl-3.0 lesser 3 (?:gnu )?lesser general public %(?: as published by the free software foundation)?(?: either)?~3(?: 0)?@
lgpl-3.0 lgpl 1 spdx % identifier lgpl 3 0@
lgpl-3.0 lgpl 4 (?:gnu )?lgpl~3(?: 0)?@
lgpl-any lesser 5 (?:gnu )?lesser general public %
lgpl-any library 5 (?:gnu )?library general public %
lgpl-any lgpl 5 (?:gnu )?lgpl(?:ed)?
gfdl-1.3 documentation 1 ^(?:gnu )?free documentation %~1 \d@
gfdl-1.3 documentation 3 (?:gnu )?free documentation %(?:~1 \d)?@
gfdl-1.3 gfdl 4 (?:gnu )?gfdl(?:~1 \d)?
gfdl-1.3 invariant 3 with no invariant sections(?: no)?(?: with no)? front cover texts(?: and)?(?: with)? no back cover texts
apache-2.0 apache 1 ^apache(?: software)? %~2(?: 0)?
apache-2.0 apache 1 spdx % identifier apache 2 0
apache-2.0 apache 2 apache org licenses? % 2 0(?: html| txt)?
apache-2.0 apache 3 apache(?: software)? %~2(?: 0)?
apache-2.0 apache 4 (?:apache|apl|asl)~2(?: 0)?(?= |$)(?! \d)
apache-1.1 apache 1 ^apache(?: software)? %~1 1
apache-1.1 apache 3 apache(?: software)? %~1 1
apache-1.0 apache 3 apache(?: software)? %~1(?: 0)?(?! 1)
apache-any apache 5 apache(?: software)? %(?! plate)d?
apache-any apache 5 apache (?:style|type|like) %
mit mit 1 ^(?:x11 )?mit(?: expat)?(?: open source)? %
mit mit 1 spdx % identifier mit(?! 0)
mit permission_is 1 permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit without_warranty 3 the software is provided as is without warranty of any kind express or implied including but not limited to
mit opensource 2 opensource org licen[cs]es? mit(?: % php| php| html)?(?! 0)
mit mit 3 (?:the )?(?:x11 )?mit(?: expat)?(?: open source)? %(?! plate)
mit mit 4 expat %|% expat|%d? mit(?! 0)
mit-any mit 5 mit (?:style|type|like) %
mit-any mit 5 mit licen[cs]ed
mit-0 mit 1 spdx % identifier mit 0
mit-0 mit 3 mit(?: %)? no attribution(?: %)?
mit-0 mit 4 mit 0(?! \d)
bsd-0-clause bsd 1 spdx % identifier 0bsd
bsd-0-clause bsd 3 (?:zero|0)(?: |)clause bsd(?: %)?
bsd-2-clause bsd 1 ^(?:2|two) clause bsd(?: style)?(?: %)?
bsd-2-clause bsd 1 spdx % identifier bsd 2 clause
bsd-2-clause bsd 3 (?:simplified|freebsd|free bsd) (?:bsd )?%
bsd-2-clause bsd 4 (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: %)?
bsd-2-clause bsd 2 opensource org licen[cs]es? bsd 2 clause
bsd-3-clause bsd 1 ^(?:3|three) clause bsd(?: style)?(?: %)?
bsd-3-clause bsd 1 spdx % identifier bsd 3 clause
bsd-3-clause bsd 3 (?:new|modified|revised) bsd(?: style)? %
bsd-3-clause bsd 4 (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: %)?
bsd-3-clause bsd 2 opensource org licen[cs]es? bsd (?:3 clause|% php)
bsd-3-clause endorse 3 neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse
bsd-4-clause bsd 1 spdx % identifier bsd 4 clause
bsd-4-clause bsd 3 (?:original|old) bsd %
bsd-4-clause bsd 4 (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: %)?
bsd-4-clause acknowledgement 3 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd redistribution 1 redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?
bsd redistributions 3 redistributions of source code must retain the above copyright notice
bsd redistributions 3 redistributions in binary form must reproduce the above copyright notice
bsd-any bsd 5 bsd(?: style| type| like)? %(?! plate)d?
isc isc 1 ^(?:the )?isc %
isc isc 1 spdx % identifier isc
isc permission_to 1 permission to use copy modify and or distribute this software for any purpose(?: with or without fee)?(?: is hereby granted)?
isc isc 3 (?:the )?isc %(?! plate)
isc internet 3 internet (?:systems|software) consortium %
hpnd permission_to 3 permission to use copy modify and distribute this software and its documentation for any purpose
mpl-1.1 mozilla 1 ^mozilla public %~1 [01]
mpl-1.1 mozilla 3 mozilla public %~1 [01]
mpl-1.1 mpl 4 mpl~1 [01]
mpl-1.1 mozilla 2 mozilla org mpl mpl 1 [01](?: html| txt)?
mpl-2.0 mozilla 1 ^mozilla public %~2(?: 0)?
mpl-2.0 mozilla 1 this source code form is subject to the terms of the mozilla public %~2(?: 0)?
mpl-2.0 mozilla 3 mozilla public %~2(?: 0)?
mpl-2.0 mpl 1 spdx % identifier mpl 2 0
mpl-2.0 mpl 4 mpl~2(?: 0)?
mpl-2.0 mozilla 2 mozilla org (?:en us )?mpl 2 0
mpl-any mozilla 5 mozilla public %
mpl-any mpl 5 (?:the |under )mpl
epl-1.0 eclipse 1 ^eclipse public %~1(?: 0)?
epl-1.0 eclipse 3 eclipse public %~1(?: 0)?
epl-1.0 epl 4 epl~1(?: 0)?
epl-1.0 eclipse 2 eclipse org (?:legal|org documents) epl v?10(?: html)?
epl-2.0 eclipse 1 ^eclipse public %~2(?: 0)?
epl-2.0 eclipse 3 eclipse public %~2(?: 0)?
epl-2.0 epl 4 epl~2(?: 0)?
epl-2.0 eclipse 2 eclipse org legal epl (?:2 0|v20)
edl-1.0 eclipse 3 eclipse distribution %(?:~1(?: 0)?)?
epl-any eclipse 5 eclipse public %
cddl-1.0 common_development 1 ^common development and distribution %(?:~1 [01])?
cddl-1.0 common_development 3 common development and distribution %(?:~1 [01])?
cddl-1.0 cddl 4 cddl(?:~1 [01])?
cpl-1.0 common_public 1 ^common public %(?:~1(?: 0)?)?
cpl-1.0 common_public 3 common public %(?:~1(?: 0)?)?
cpl-1.0 cpl 4 cpl~1 0
cpal-1.0 attribution 3 common public attribution %(?:~1(?: 0)?)?
ipl-1.0 ibm 3 ibm public %(?:~1(?: 0)?)?
eupl-1.2 european 1 ^european union public %(?:~1 \d)?
eupl-1.2 european 3 european union public %(?:~1 \d)?
eupl-1.2 eupl 4 eupl(?:~1 \d)?
cecill cecill 4 (?:the )?cecill (?:(?:b|c) )?(?:free software )?%
cecill cecill 1 ^cecill(?: b| c)?(?:~\d)?
artistic-2.0 artistic 1 ^artistic %~2(?: 0)?
artistic-2.0 artistic 3 artistic %~2(?: 0)?
artistic-2.0 artistic 4 artistic 2 0
artistic-1.0 artistic 3 artistic %~1(?: 0)?
artistic-any artistic 5 (?:perl )?artistic %
bsl-1.0 boost 1 ^boost software %(?:~1(?: 0)?)?
bsl-1.0 boost 3 boost software %(?:~1(?: 0)?)?
bsl-1.0 boost 2 boost org % 1 0(?: txt)?
bsl-1.0 boost 5 boost %(?! plate)
busl-1.1 business_source 1 ^business source %(?:~1 1)?
busl-1.1 business_source 3 business source %(?:~1 1)?
busl-1.1 bsl 4 bu?sl~1 1
sspl-1.0 server_side 1 ^server side public %(?:~1(?: 0)?)?
sspl-1.0 server_side 3 server side public %(?:~1(?: 0)?)?
sspl-1.0 sspl 4 sspl(?:~1(?: 0)?)?
elastic-2.0 elastic 1 ^elastic %(?:~2(?: 0)?)?
elastic-2.0 elastic 3 elastic %(?:~2(?: 0)?)?
elastic-2.0 elv2 4 elv2
polyform polyform 3 polyform (?:noncommercial|non commercial|small business|shield|strict|perimeter|free trial|internal use) %(?:~1(?: 0)?(?: 0)?)?
prosperity prosperity 3 prosperity public %(?:~\d(?: 0)?)?
parity parity 3 parity public %(?:~\d(?: 0)?)?
unlicense unencumbered 1 this is free and unencumbered software released into the public domain
unlicense unlicense 1 spdx % identifier unlicense
unlicense unlicense 2 unlicense org
unlicense unlicense 4 (?:the |under )unlicense
public-domain public_domain 1 (?:is|are|been|was|hereby|) ?(?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain
public-domain public_domain 3 public domain (?:dedication|declaration|notice|mark|work)(?: 1 0)?
public-domain public_domain 5 (?:is|are|be) (?:now )?in the public domain
cc0-1.0 cc0 1 spdx % identifier cc0 1 0
cc0-1.0 cc0 1 ^cc0(?:~1(?: 0)?)?(?: universal)?
cc0-1.0 cc0 4 cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 creative 3 creative commons (?:zero|cc0|0)(?:~1(?: 0)?)?(?: universal)?(?: public domain dedication)?
cc0-1.0 creativecommons 2 creativecommons org publicdomain (?:zero 1 0|mark 1 0)
wtfpl fuck 1 do what the fuck you want to public %(?:~\d)?
wtfpl wtfpl 4 wtfpl(?:~\d)?
zlib zlib 1 ^zlib(?: libpng)? %
zlib zlib 3 (?:the )?zlib(?: libpng)? %(?! plate)
zlib as_is 3 this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng libpng 3 (?:the )?libpng %(?:~2)?|png reference library %
libtiff libtiff 3 libtiff %
curl curl 3 (?:the )?curl %(?! plate)
openssl openssl 1 ^(?:the )?openssl %
openssl openssl 3 openssl (?:and ssleay )?%|dual openssl ssleay %
openssl openssl 3 this product includes software developed by the openssl project
postgresql postgresql 1 ^postgresql %
postgresql postgresql 3 (?:the )?postgresql %
python-2.0 python 1 ^(?:python software foundation|psf) %(?:~2(?: 0)?)?
python-2.0 python 3 python software foundation %(?:~2(?: 0)?)?
python-2.0 psf 4 psf(?: %|f? 2 0)
python-2.0 python 5 python %(?! plate)(?:~\d)?
ruby ruby 3 same (?:terms|%) as ruby
ruby ruby 5 ruby %(?! plate)
php-3.01 php 1 ^(?:the )?php %(?:~3(?: 01?)?)?
php-3.01 php 3 (?:the )?php %~3(?: 01?)?
php-3.01 php 2 php net % 3 01?(?: txt)?
php-any php 5 php %(?! plate)
perl perl 1 (?:under|on) the same terms as (?:the )?perl(?: ?5)?(?: itself| programming language system itself)?
perl perl 5 (?:the |under )perl(?: ?5)? %(?! plate)
tcl tcl 3 tcl(?: tk)? %(?! plate)
vim vim 3 vim %(?! plate)
x11 x11 3 (?:the )?x11 %(?! plate)|x11 distribution modification variant
x11 consortium 3 (?:mit )?x consortium %
xfree86 xfree86 3 xfree86 %(?:~1 1)?
ncsa illinois 3 university of illinois (?:ncsa )?open source %
ncsa ncsa 4 ncsa %|^ncsa
afl-3.0 academic 1 ^academic free %(?:~\d(?: \d)?)?
afl-3.0 academic 3 academic free %(?:~\d(?: \d)?)?
afl-3.0 afl 4 afl~\d \d
ecl-2.0 educational 3 educational community %(?:~2(?: 0)?)?
osl-3.0 open_software 1 ^open software %(?:~\d(?: \d)?)?
osl-3.0 open_software 3 open software %~\d(?: \d)?
osl-3.0 osl 4 osl~\d \d
rpl-1.5 reciprocal 3 reciprocal public %(?:~1 [15])?
qpl-1.0 public 3 q public %(?:~1(?: 0)?)?
ms-pl microsoft 1 ^microsoft (?:permissive|public) %
ms-pl microsoft 3 microsoft (?:permissive|public) %
ms-pl ms_pl 4 ms pl(?! \d)
ms-rl microsoft 3 microsoft reciprocal %
ms-rl ms_rl 4 ms rl(?! \d)
apsl-2.0 apple 3 apple public source %(?:~\d(?: \d)?)?
nasa-1.3 nasa 3 nasa open source agreement(?:~1 3)?
sgi-b-2.0 sgi 3 sgi free software %(?: b)?(?:~\d(?: \d)?)?
upl-1.0 universal 3 universal permissive %(?:~1(?: 0)?)?
w3c w3c 3 w3c (?:software (?:notice )?(?:and )?(?:document )?)?(?:notice and )?%
unicode unicode 3 unicode (?:data files and software )?%(?:~3)?(?: agreement)?
intel-acpi intel 3 intel acpi %|intel open source %
ofl-1.1 open_font 1 ^(?:sil )?open font %(?:~1 [01])?
ofl-1.1 open_font 3 (?:sil )?open font %(?:~1 [01])?
ofl-1.1 ofl 4 (?:sil )?ofl(?:~1 [01])
ofl-1.1 scripts_sil 2 scripts sil org ofl
ubuntu-font ubuntu 3 ubuntu font %(?:~1(?: 0)?)?
bitstream-vera bitstream 3 bitstream vera (?:fonts )?(?:%|copyright)
odbl-1.0 open_database 1 ^open (?:data commons open )?database %(?:~1(?: 0)?)?
odbl-1.0 open_database 3 open database %(?:~1(?: 0)?)?
odbl-1.0 odbl 4 odbl(?:~1(?: 0)?)?
odbl-1.0 opendatacommons 2 opendatacommons org licenses odbl
odc-by-1.0 open_data_commons 3 open data commons attribution %(?:~1(?: 0)?)?
odc-by-1.0 odc 4 odc by(?: 1 0)?
odc-by-1.0 opendatacommons 2 opendatacommons org licenses by
pddl-1.0 open_data_commons 3 open data commons public domain dedication and %(?:~1(?: 0)?)?
pddl-1.0 pddl 4 pddl(?:~1(?: 0)?)?
cdla community_data 3 community data %(?: agreement)? (?:permissive|sharing)(?:~\d(?: \d)?)?
ogl open_government 1 ^open government %(?:~\d(?: 0)?)?
ogl open_government 3 open government %(?:~\d(?: 0)?)?
etalab etalab 3 (?:licence ouverte )?etalab(?: licence ouverte)?(?:~\d(?: 0)?)?
dl-de datenlizenz 3 datenlizenz deutschland (?:namensnennung|zero)(?:~2(?: 0)?)?
cc-by-nc-nd creative 3 creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?:~\d(?: \d)?)?(?: international| unported| generic)?(?: %)?
cc-by-nc-nd cc_by 4 cc by nc nd(?: \d(?: \d)?)?
cc-by-nc-nd creativecommons 2 creativecommons org licen[cs]es? by nc nd(?: \d \d)?
cc-by-nc-sa creative 3 creative commons attribution non ?commercial share ?alike(?:~\d(?: \d)?)?(?: international| unported| generic)?(?: %)?
cc-by-nc-sa cc_by 4 cc by nc sa(?: \d(?: \d)?)?
cc-by-nc-sa creativecommons 2 creativecommons org licen[cs]es? by nc sa(?: \d \d)?
cc-by-nc creative 3 creative commons attribution non ?commercial(?:~\d(?: \d)?)?(?: international| unported| generic)?(?: %)?
cc-by-nc cc_by 4 cc by nc(?: \d(?: \d)?)?
cc-by-nc creativecommons 2 creativecommons org licen[cs]es? by nc(?: \d \d)?
cc-by-nd creative 3 creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?:~\d(?: \d)?)?(?: international| unported| generic)?(?: %)?
cc-by-nd cc_by 4 cc by nd(?: \d(?: \d)?)?
cc-by-nd creativecommons 2 creativecommons org licen[cs]es? by nd(?: \d \d)?
cc-by-sa creative 3 creative commons attribution share ?alike(?:~\d(?: \d)?)?(?: international| unported| generic)?(?: %)?
cc-by-sa cc_by 4 cc by sa(?: \d(?: \d)?)?
cc-by-sa creativecommons 2 creativecommons org licen[cs]es? by sa(?: \d \d)?
cc-by-4.0 creative 1 ^(?:a )?creative commons attribution(?: %)?~4(?: 0)?(?: international)?(?: %)?
cc-by-4.0 creative 3 creative commons attribution(?: %)?~4(?: 0)?(?: international)?(?: %)?
cc-by-4.0 cc_by 4 cc by~4(?: 0)?
cc-by-4.0 creativecommons 2 creativecommons org licen[cs]es? by 4 0
cc-by-3.0 creative 3 creative commons attribution(?: %)?~3(?: 0)?(?: unported| united states)?(?: %)?
cc-by-3.0 cc_by 4 cc by~3(?: 0)?
cc-by-3.0 creativecommons 2 creativecommons org licen[cs]es? by 3 0
cc-by-2.0 creative 3 creative commons attribution(?: %)?~2(?: [05])?(?: generic)?(?: %)?
cc-by-2.0 cc_by 4 cc by~2(?: [05])?
cc-by-any cc_by 5 cc by(?! \d)
creative-commons creative 5 (?:a )?creative commons(?: attribution)?(?: public)?(?: %)
creative-commons creative 5 under (?:a )?creative commons
rail openrail 3 (?:bigscience |creativeml )?(?:open ?rail|openrail)(?: m| ?\+\+ ?m)?(?: %)?
rail responsible_ai 3 responsible ai %
llama-community community_license 3 llama \d(?: \d)? community % agreement
proprietary confidential 1 (?:strictly )?(?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary unauthori 1 unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|material|work)(?: via any medium)? is (?:strictly )?prohibited
proprietary end_user 3 end user % agreement
proprietary eula 4 (?:the |this )eula
proprietary proprietary 5 proprietary (?:software )?%(?! plate)
proprietary commercial 5 commercial (?:software )?% (?:agreement|terms|key)
proprietary trade_secret 3 (?:contains|constitutes?) (?:confidential )?(?:information and )?trade secrets? of
evaluation evaluation 3 (?:for )?evaluation (?:purposes )?only(?: not for production use)?
non-commercial commercial 3 (?:for )?(?:non ?commercial|personal) use only
non-commercial research 3 for research (?:and educational )?(?:purposes|use) only
all-rights-reserved reserved 1 copyright (?:c )?(?:\d{4} )+(?:[^ ]+ ){1,8}all rights reserved
all-rights-reserved reserved 3 all rights (?:are )?reserved
all-rights-reserved publication 3 no part of this (?:publication|book|work|document|website) may be (?:reproduced|copied|stored|transmitted)
all-rights-reserved derechos 3 todos (?:los )?derechos reservados
all-rights-reserved direitos 3 todos os direitos reservados
all-rights-reserved droits 3 tous (?:les )?droits (?:de reproduction )?r\xc3\xa9serv\xc3\xa9s|tous (?:les )?droits reserves
all-rights-reserved rechte 3 alle rechte (?:sind )?vorbehalten
all-rights-reserved diritti 3 tutti i diritti (?:sono )?riservati
all-rights-reserved rechten 3 alle rechten voorbehouden
copyright copyright 5 copyright (?:c |by |owners? |holders? )?(?:\d{4}(?: \d{4})*)
copyright copyright 5 (?:the (?:above )?)?copyright (?:holders?|owners?|notice)
copyright xc2 5 \xc2\xa9 ?\d{4}
open-source open_source 5 (?:free and )?open source (?:software )?%d?(?! plate)
open-source osi 5 osi (?:approved|certified)(?: open source)?(?: %)?
dual-license dual 4 dual(?:ly)? licen[cs]ed?(?: under)?
licensed licen 5 (?<!not )(?<!never )(?<!nor )licen[cs]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of|following|same|a|an|this|that)
licensed licen 5 see (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?: file)?(?: txt| md)?(?: file)? for (?:details|more|the full|full|licen)
licensed licen 5 (?:subject to|under) the (?:terms of the )?(?:following )?licen[cs]e (?:agreement|terms|below|in the)
""".strip()
WEIGHTS = {1: 0.95, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.5}


class Rule(NamedTuple):
    priority: int
    label: str
    gate: bytes
    pattern: re.Pattern[bytes]
    weight: float


def whole(expression: str) -> re.Pattern[bytes]:
    """The expression where it begins and ends with whole words."""
    return re.compile((r"(?<![^ ])(?:" + expression + r")(?![^ ])").encode("latin-1"))


def rules() -> list[Rule]:
    """All rules by priority, then as written."""
    out: list[Rule] = []
    for line in RULES.split("\n"):
        label, gate, priority, expression = line.split(" ", 3)
        for sign, meant in SHORT.items():
            expression = re.sub(r"(?<![\[\\])" + re.escape(sign), lambda _: meant, expression)
        gate = {"xc2": "\xc2\xa9"}.get(gate, gate.replace("_", " "))
        out.append(Rule(int(priority), label, gate.encode("latin-1"), whole(expression), WEIGHTS[int(priority)]))
    return sorted(out, key=lambda r: r.priority)


class Found(NamedTuple):
    start: int
    end: int
    rule: Rule


def words_of(text: bytes) -> bytes:
    """The words of a text, lower-cased, one space apart."""
    return b" ".join(WORD.findall(text.lower()))


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None) -> None:
        self.by_gate: dict[bytes, list[Rule]] = {}
        for r in ordered or rules():
            self.by_gate.setdefault(r.gate, []).append(r)
        self.base = [(whole(words), words.encode(), label) for words, label in BASE]

    def detections(self, words: bytes) -> list[Found]:
        """What stays after suppression, by place; words as words_of() gives them."""
        found = []
        for gate, gated in self.by_gate.items():
            if gate in words:
                found += [Found(*m.span(), r) for r in gated for m in r.pattern.finditer(words)]
        kept: list[Found] = []
        for priority in sorted({f.rule.priority for f in found}):
            level = sorted((f for f in found if f.rule.priority == priority), key=lambda f: (f.start, -f.end))
            starts = np.array([f.start for f in kept], np.int64)
            order = np.argsort(starts, kind="stable")
            starts = starts[order]
            reach = np.maximum.accumulate(np.array([f.end for f in kept], np.int64)[order]) if kept else starts
            last, new = -1, []
            for f in level:
                at = int(np.searchsorted(starts, f.start, side="right"))
                if (at and reach[at - 1] >= f.end) or f.end <= last:
                    continue
                new.append(f)
                last = f.end
            kept += new
        return sorted(kept, key=lambda f: (f.start, f.end))

    def base_places(self, words: bytes) -> list[tuple[int, str]]:
        return sorted((m.start(), label) for pattern, phrase, label in self.base if phrase in words for m in pattern.finditer(words))


def numbers(words: bytes, places: list[int]) -> dict[int, int]:
    """Number of the word that begins at each place."""
    out, at, count = {}, 0, 0
    for place in sorted(set(places)):
        count += words.count(b" ", at, place)
        at = place
        out[place] = count
    return out


COLUMNS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("detections", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("weight", pa.float64())]))),
])
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label string, word long, weight double>>"
)


def scanned_text(scanner: Scanner, text: bytes) -> tuple:
    """A row of RESULT but for its doc_id. The score takes each label's best weight as the chance that it is meant."""
    words = words_of(text)
    base, found = scanner.base_places(words), scanner.detections(words)
    nth = numbers(words, [at for at, _ in base] + [f.start for f in found])
    places, of_base, best = [nth[at] for at, _ in base], {label for _, label in base}, {}
    for f in found:
        best[f.rule.label] = max(best.get(f.rule.label, 0.0), f.rule.weight)
    score = 1.0 - float(np.prod([1.0 - best[x] for x in sorted(best)])) if best else 0.0
    labels = ",".join(sorted(best.keys() | of_base))
    detections = [{"label": f.rule.label, "word": nth[f.start], "weight": f.rule.weight} for f in found]
    n = words.count(b" ") + bool(words)
    return n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(of_base)), labels, max(score, 0.5 * bool(base)), detections


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections: label, word (start) and weight of each."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [(doc_id, *scanned_text(scanner, text)) for doc_id, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COLUMNS, strict=True)], schema=COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents")).drop("detections")

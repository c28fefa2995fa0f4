"""The signatures of license scans, written by hand and in order: priority, weight, label, keyword, words pattern.

Lower priorities come first: 1 grants "or later" and license places on the web, 2 identifiers and passages of license texts,
3 names with a version, 4 bare names, 5 hints. ``{L}`` is either spelling of license, ``{BY}`` the words of a grant, ``{V}`` a
mark of a version; numbers end where no further number follows. The keyword is a literal part of every match.
"""

from __future__ import annotations

from dataclasses import dataclass

MACROS = {
    "{L}": "licen[cs]e",
    "{BY}": r"(?:licen[cs]ed|released|distributed|available|provided|published|covered) (?:\S+ ){0,3}?(?:under|by) (?:the |an? )?(?:terms of (?:the )?)?",
    "{V}": "(?: version| ver| v)? v?",
    "{END}": r"(?! \d)",
    "{LATER}": r"(?: of the licen[cs]e)? or (?:at your option )?(?:\(?any )?later(?: version)?",
}

SIGNATURES = r"""
1 0.99 gpl-3.0-or-later | general public | (?<!affero )(?<!lesser )(?<!library )general public {L}(?: as published by the free software foundation)?(?: either)?{V}3(?: 0)?{LATER}
1 0.99 gpl-2.0-or-later | general public | (?<!affero )(?<!lesser )(?<!library )general public {L}(?: as published by the free software foundation)?(?: either)?{V}2(?: 0)?{LATER}
1 0.99 gpl-1.0-or-later | general public | (?<!affero )(?<!lesser )(?<!library )general public {L}(?: as published by the free software foundation)?(?: either)?{V}1(?: 0)?{LATER}
1 0.99 lgpl-3.0-or-later | lesser general public | lesser general public {L}(?: as published by the free software foundation)?(?: either)?{V}3(?: 0)?{LATER}
1 0.99 lgpl-2.1-or-later | lesser general public | lesser general public {L}(?: as published by the free software foundation)?(?: either)?{V}2 1{LATER}
1 0.99 lgpl-2.0-or-later | library general public | library general public {L}(?: as published by the free software foundation)?(?: either)?{V}2(?: 0)?{LATER}
1 0.99 agpl-3.0-or-later | affero general public | affero general public {L}(?: as published by the free software foundation)?(?: either)?{V}3(?: 0)?{LATER}
1 0.99 fdl-1.3-or-later | free documentation | free documentation {L}{V}1 3{LATER}
1 0.99 fdl-1.2-or-later | free documentation | free documentation {L}{V}1 2{LATER}
1 0.99 fdl-1.1-or-later | free documentation | free documentation {L}{V}1 1{LATER}
1 0.98 gpl-3.0-or-later | gpl | gpl ?v?3(?: 0)? or later
1 0.98 gpl-2.0-or-later | gpl | gpl ?v?2(?: 0)? or later
1 0.98 lgpl-3.0-or-later | lgpl | lgpl ?v?3(?: 0)? or later
1 0.98 lgpl-2.1-or-later | lgpl | lgpl ?v?2 1 or later
1 0.98 agpl-3.0-or-later | agpl | agpl ?v?3(?: 0)? or later
1 0.97 gpl-3.0-or-later | gplv3 | gplv3 or later
1 0.97 gpl-2.0-or-later | gplv2 | gplv2 or later
1 0.98 cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
1 0.98 cc-pdm-1.0 | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
1 0.98 cc-by-4.0 | creativecommons org licenses by 4 | creativecommons org licenses by 4 0
1 0.98 cc-by-3.0 | creativecommons org licenses by 3 | creativecommons org licenses by 3 0
1 0.98 cc-by-2.5 | creativecommons org licenses by 2 | creativecommons org licenses by 2 5
1 0.98 cc-by-2.0 | creativecommons org licenses by 2 | creativecommons org licenses by 2 0
1 0.98 cc-by-sa-4.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
1 0.98 cc-by-sa-3.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 3 0
1 0.98 cc-by-sa-2.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 2 0
1 0.98 cc-by-nd-4.0 | creativecommons org licenses by nd | creativecommons org licenses by nd 4 0
1 0.98 cc-by-nc-4.0 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
1 0.98 cc-by-nc-3.0 | creativecommons org licenses by nc | creativecommons org licenses by nc 3 0
1 0.98 cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 4 0
1 0.98 cc-by-nc-sa-3.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 3 0
1 0.98 cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd 4 0
1 0.98 cc-by-nc-nd-3.0 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd 3 0
1 0.98 apache-2.0 | apache org licenses | apache org licenses license 2 0(?: txt| html)?
1 0.97 mit | opensource org licenses | opensource org licenses mit(?: license php)?
1 0.97 bsd-3-clause | opensource org licenses | opensource org licenses bsd 3 clause
1 0.97 bsd-2-clause | opensource org licenses | opensource org licenses bsd 2 clause
1 0.97 gpl-3.0 | gnu org licenses | gnu org licenses gpl 3 0(?: html| txt| en html)?
1 0.97 gpl-2.0 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
1 0.97 lgpl-3.0 | gnu org licenses | gnu org licenses lgpl 3 0(?: html| txt)?
1 0.97 agpl-3.0 | gnu org licenses | gnu org licenses agpl 3 0(?: html| txt)?
1 0.97 mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
1 0.97 mpl-1.1 | mozilla org mpl | mozilla org mpl mpl 1 1(?: html)?
1 0.97 epl-2.0 | eclipse org legal | eclipse org legal epl (?:v20|2 0)(?: html)?
1 0.97 epl-1.0 | eclipse org legal | eclipse org legal epl v10(?: html)?
1 0.97 ofl-1.1 | scripts sil org | scripts sil org ofl
1 0.97 unlicense | unlicense org | unlicense org
1 0.97 bsl-1.0 | boost org license | boost org license 1 0 txt
2 0.96 apache-2.0 | spdx | spdx {L} identifier apache 2 0
2 0.96 mit | spdx | spdx {L} identifier mit
2 0.96 isc | spdx | spdx {L} identifier isc
2 0.96 zlib | spdx | spdx {L} identifier zlib
2 0.96 bsd-2-clause | spdx | spdx {L} identifier bsd 2 clause
2 0.96 bsd-3-clause | spdx | spdx {L} identifier bsd 3 clause
2 0.96 0bsd | spdx | spdx {L} identifier 0bsd
2 0.96 gpl-2.0-only | spdx | spdx {L} identifier gpl 2 0(?: only)?(?! or)
2 0.96 gpl-3.0-only | spdx | spdx {L} identifier gpl 3 0(?: only)?(?! or)
2 0.96 lgpl-2.1-only | spdx | spdx {L} identifier lgpl 2 1(?: only)?(?! or)
2 0.96 lgpl-3.0-only | spdx | spdx {L} identifier lgpl 3 0(?: only)?(?! or)
2 0.96 agpl-3.0-only | spdx | spdx {L} identifier agpl 3 0(?: only)?(?! or)
2 0.96 mpl-2.0 | spdx | spdx {L} identifier mpl 2 0
2 0.96 epl-2.0 | spdx | spdx {L} identifier epl 2 0
2 0.96 bsl-1.0 | spdx | spdx {L} identifier bsl 1 0
2 0.96 unlicense | spdx | spdx {L} identifier unlicense
2 0.96 cc0-1.0 | spdx | spdx {L} identifier cc0 1 0
2 0.95 mit | hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
2 0.95 mit | above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 0.95 isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 0.95 unlicense | unencumbered | this is free and unencumbered software released into the public domain
2 0.93 bsd | binary forms with or without | redistribution and use in source and binary forms with or without modification are permitted
2 0.94 bsd-3-clause | neither the name | neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|other) contributors may be used
2 0.94 bsd-4-clause | mentioning features | all advertising materials mentioning features or use of this software must display
2 0.94 zlib | origin of this software | the origin of this software must not be misrepresented
2 0.94 apache-2.0 | apache license version 2 0 | licensed under the apache license version 2 0
2 0.9 apache-2.0 | in compliance with the | you may not use this file except in compliance with the {L}
2 0.94 mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public {L} v 2 0
2 0.93 mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public {L} version 1 1
2 0.93 cddl-1.0 | common development | the contents of this file are subject to the terms of the common development and distribution {L}
2 0.93 bsl-1.0 | boost software | boost software {L} version 1 0 august 17th 2003
2 0.93 wtfpl | what the | do what the fuck you want to public {L}
2 0.93 beerware | buy me a beer | you can buy me a beer in return
2 0.93 ofl-1.1 | sil open font | this font software is licensed under the sil open font {L} version 1 1
2 0.93 postgresql | without a written agreement | without a written agreement is hereby granted
2 0.93 openssl | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
2 0.93 ncsa | university of illinois | university of illinois ncsa open source {L}
2 0.93 cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights
2 0.93 public-domain | dedicates the work | the author dedicates the work to the public domain
2 0.92 cc-by-4.0 | attribution 4 0 | attribution 4 0 international
2 0.92 cc-by-sa-4.0 | sharealike 4 0 | attribution sharealike 4 0 international
2 0.92 cc-by-nc-4.0 | noncommercial 4 0 | attribution noncommercial 4 0 international
2 0.92 cc-by-nd-4.0 | noderivatives 4 0 | attribution noderivatives 4 0 international
2 0.92 cc-by-nc-sa-4.0 | noncommercial sharealike 4 0 | attribution noncommercial sharealike 4 0 international
2 0.92 cc-by-nc-nd-4.0 | noncommercial noderivatives 4 0 | attribution noncommercial noderivatives 4 0 international
3 0.93 apache-2.0 | apache | (?:{BY})?apache (?:software )?(?:foundation )?{L}{V}2(?: 0)?{END}
3 0.93 apache-1.1 | apache | (?:{BY})?apache (?:software )?{L}{V}1 1
3 0.93 apache-1.0 | apache | (?:{BY})?apache (?:software )?{L}{V}1 0
3 0.93 agpl-3.0 | affero general public | (?:{BY})?(?:gnu )?affero general public {L}{V}3(?: 0)?{END}
3 0.93 agpl-1.0 | affero general public | (?:{BY})?(?:gnu )?affero general public {L}{V}1(?: 0)?{END}
3 0.93 lgpl-3.0 | lesser general public | (?:{BY})?(?:gnu )?lesser general public {L}{V}3(?: 0)?{END}
3 0.93 lgpl-2.1 | lesser general public | (?:{BY})?(?:gnu )?lesser general public {L}{V}2 1{END}
3 0.93 lgpl-2.0 | library general public | (?:{BY})?(?:gnu )?library general public {L}{V}2(?: 0)?{END}
3 0.92 gpl-3.0 | general public | (?:{BY})?(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public {L}{V}3(?: 0)?{END}
3 0.92 gpl-2.0 | general public | (?:{BY})?(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public {L}{V}2(?: 0)?{END}
3 0.92 gpl-1.0 | general public | (?:{BY})?(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public {L}{V}1(?: 0)?{END}
3 0.92 fdl-1.3 | free documentation | (?:{BY})?(?:gnu )?free documentation {L}{V}1 3
3 0.92 fdl-1.2 | free documentation | (?:{BY})?(?:gnu )?free documentation {L}{V}1 2
3 0.92 fdl-1.1 | free documentation | (?:{BY})?(?:gnu )?free documentation {L}{V}1 1
3 0.92 mpl-2.0 | mozilla public | (?:{BY})?mozilla public {L}{V}2(?: 0)?{END}
3 0.92 mpl-1.1 | mozilla public | (?:{BY})?mozilla public {L}{V}1 1
3 0.92 mpl-1.0 | mozilla public | (?:{BY})?mozilla public {L}{V}1(?: 0)?{END}
3 0.92 epl-2.0 | eclipse public | (?:{BY})?eclipse public {L}{V}2(?: 0)?{END}
3 0.92 epl-1.0 | eclipse public | (?:{BY})?eclipse public {L}{V}1(?: 0)?{END}
3 0.92 cddl-1.1 | common development | (?:{BY})?common development and distribution {L}{V}1 1
3 0.92 cddl-1.0 | common development | (?:{BY})?common development and distribution {L}{V}1(?: 0)?{END}
3 0.92 cpl-1.0 | common public | (?:{BY})?common public {L}{V}1(?: 0)?{END}
3 0.92 eupl-1.2 | european union public | (?:{BY})?european union public {L}{V}1 2
3 0.92 eupl-1.1 | european union public | (?:{BY})?european union public {L}{V}1 1
3 0.92 eupl-1.0 | european union public | (?:{BY})?european union public {L}{V}1(?: 0)?{END}
3 0.92 afl-3.0 | academic free | (?:{BY})?academic free {L}{V}3(?: 0)?{END}
3 0.92 afl-2.1 | academic free | (?:{BY})?academic free {L}{V}2 1
3 0.92 afl-2.0 | academic free | (?:{BY})?academic free {L}{V}2(?: 0)?{END}
3 0.92 osl-3.0 | open software | (?:{BY})?open software {L}{V}3(?: 0)?{END}
3 0.92 osl-2.1 | open software | (?:{BY})?open software {L}{V}2 1
3 0.92 osl-1.0 | open software | (?:{BY})?open software {L}{V}1(?: 0)?{END}
3 0.92 artistic-2.0 | artistic | (?:{BY})?artistic {L}{V}2(?: 0)?{END}
3 0.92 artistic-1.0 | artistic | (?:{BY})?artistic {L}{V}1(?: 0)?{END}
3 0.92 bsl-1.0 | boost software | (?:{BY})?boost software {L}{V}1(?: 0)?{END}
3 0.92 zpl-2.1 | zope public | (?:{BY})?zope public {L}{V}2 1
3 0.92 zpl-2.0 | zope public | (?:{BY})?zope public {L}{V}2(?: 0)?{END}
3 0.92 psf-2.0 | python software foundation | (?:{BY})?python software foundation {L}{V}2(?: 0)?{END}
3 0.92 ofl-1.1 | open font | (?:{BY})?(?:sil )?open font {L}{V}1 1
3 0.92 ofl-1.0 | open font | (?:{BY})?(?:sil )?open font {L}{V}1(?: 0)?{END}
3 0.92 odbl-1.0 | open database | (?:{BY})?open database {L}{V}1(?: 0)?{END}
3 0.92 lppl-1.3 | latex project public | (?:{BY})?latex project public {L}{V}1 3
3 0.92 lppl-1.2 | latex project public | (?:{BY})?latex project public {L}{V}1 2
3 0.92 cecill-2.1 | cecill | (?:{BY})?cecill(?: free software)?(?: {L})?{V}2 1
3 0.92 cecill-2.0 | cecill | (?:{BY})?cecill(?: free software)?(?: {L})?{V}2(?: 0)?{END}
3 0.92 cecill-1.1 | cecill | (?:{BY})?cecill(?: free software)?(?: {L})?{V}1 1
3 0.92 cecill-1.0 | cecill | (?:{BY})?cecill(?: free software)?(?: {L})?{V}1(?: 0)?{END}
3 0.92 busl-1.1 | business source | (?:{BY})?business source {L}{V}1 1
3 0.92 sspl-1.0 | server side public | (?:{BY})?server side public {L}{V}1(?: 0)?{END}
3 0.9 gpl-3.0 | gpl | (?<!\S)gpl ?v?3(?: 0)?{END}
3 0.9 gpl-2.0 | gpl | (?<!\S)gpl ?v?2(?: 0)?{END}
3 0.9 lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?{END}
3 0.9 lgpl-2.1 | lgpl | lgpl ?v?2 1
3 0.9 agpl-3.0 | agpl | agpl ?v?3(?: 0)?{END}
3 0.9 mpl-2.0 | mpl | mpl ?v?2(?: 0)?{END}
3 0.9 mpl-1.1 | mpl | mpl ?v?1 1
3 0.9 epl-2.0 | epl | epl ?v?2(?: 0)?{END}
3 0.9 epl-1.0 | epl | epl ?v?1(?: 0)?{END}
3 0.9 cddl-1.0 | cddl | cddl ?v?1(?: 0)?{END}
3 0.9 eupl-1.2 | eupl | eupl ?v?1 2
3 0.95 cc-by-4.0 | cc by 4 | cc by 4 0
3 0.95 cc-by-3.0 | cc by 3 | cc by 3 0
3 0.95 cc-by-2.0 | cc by 2 | cc by 2 0
3 0.95 cc-by-sa-4.0 | cc by sa | cc by sa 4 0
3 0.95 cc-by-sa-3.0 | cc by sa | cc by sa 3 0
3 0.95 cc-by-nd-4.0 | cc by nd | cc by nd 4 0
3 0.95 cc-by-nc-4.0 | cc by nc | cc by nc 4 0
3 0.95 cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
3 0.95 cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
3 0.94 cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
3 0.94 cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
3 0.93 cc-by-sa | creative commons attribution | creative commons attribution share ?alike
3 0.93 cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
3 0.92 cc-by-nc | creative commons attribution | creative commons attribution non ?commercial(?! (?:no ?deriv|share ?alike))
3 0.92 cc-by | creative commons attribution | creative commons attribution(?! (?:non ?commercial|no ?deriv|share ?alike))
3 0.95 cc0-1.0 | cc0 | cc0(?: 1(?: 0)?)?
3 0.92 bsd-4-clause | bsd | (?:4|four) clause bsd|bsd (?:4|four) clause|original bsd {L}
3 0.92 bsd-3-clause | bsd | (?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|revised|modified) bsd {L}
3 0.92 bsd-2-clause | bsd | (?:2|two) clause bsd|bsd (?:2|two) clause|(?:simplified|freebsd) bsd {L}
3 0.92 0bsd | bsd | zero clause bsd|0 clause bsd|0bsd
4 0.8 apache | apache | (?:{BY})?apache (?:software )?{L}
4 0.8 agpl | affero | (?:{BY})?(?:gnu )?affero general public {L}
4 0.8 lgpl | general public | (?:{BY})?(?:gnu )?(?:lesser|library) general public {L}
4 0.75 gpl | general public | (?:{BY})?(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public {L}
4 0.8 fdl | free documentation | (?:{BY})?(?:gnu )?free documentation {L}
4 0.8 mpl | mozilla public | (?:{BY})?mozilla public {L}
4 0.8 epl | eclipse public | (?:{BY})?eclipse public {L}
4 0.8 cddl | common development | (?:{BY})?common development and distribution {L}
4 0.8 cpl | common public | (?:{BY})?common public {L}
4 0.8 eupl | european union public | (?:{BY})?european union public {L}
4 0.8 afl | academic free | (?:{BY})?academic free {L}
4 0.8 osl | open software | (?:{BY})?open software {L}
4 0.8 artistic | artistic | (?:{BY})?artistic {L}
4 0.8 bsl | boost software | (?:{BY})?boost software {L}
4 0.8 zpl | zope public | (?:{BY})?zope public {L}
4 0.8 psf | python software foundation | (?:{BY})?python software foundation {L}
4 0.8 ofl | open font | (?:{BY})?(?:sil )?open font {L}
4 0.8 odbl | open database | (?:{BY})?open database {L}
4 0.8 lppl | latex project public | (?:{BY})?latex project public {L}
4 0.7 cecill | cecill | (?:{BY})?cecill(?: free software)?(?: {L})?
4 0.8 busl | business source | (?:{BY})?business source {L}
4 0.8 sspl | server side public | (?:{BY})?server side public {L}
4 0.85 mit | mit | (?:{BY}|under the )?mit(?: style| x11)? {L}|{L} mit(?= |$)
4 0.85 mit | expat | (?:{BY})?expat {L}
4 0.85 x11 | x11 | (?:{BY})?x11 {L}
4 0.85 isc | isc | (?:{BY})?isc {L}
4 0.85 zlib | zlib | (?:{BY})?zlib(?: libpng)? {L}
4 0.85 libpng | libpng | (?:{BY})?libpng {L}
4 0.85 unlicense | unlicense | (?:the )?unlicense
4 0.85 wtfpl | wtfpl | wtfpl
4 0.85 beerware | beerware | beerware(?: {L})?
4 0.85 ms-pl | microsoft public | microsoft public {L}
4 0.85 ms-rl | microsoft reciprocal | microsoft reciprocal {L}
4 0.85 postgresql | postgresql | postgresql {L}
4 0.85 php | php | php {L}
4 0.85 ruby | ruby | ruby {L}
4 0.85 openssl | openssl | openssl {L}
4 0.85 ncsa | ncsa | ncsa(?: open source)? {L}
4 0.85 upl-1.0 | universal permissive | universal permissive {L}
4 0.85 blueoak-1.0.0 | blue oak | blue oak model {L}
4 0.75 bsd | bsd | (?:{BY})?(?:bsd|berkeley software distribution bsd)(?: style)? {L}
4 0.75 cc-by-nc-nd | cc by nc nd | cc by nc nd
4 0.75 cc-by-nc-sa | cc by nc sa | cc by nc sa
4 0.75 cc-by-nc | cc by nc | cc by nc(?! (?:nd|sa)(?: |$))
4 0.75 cc-by-nd | cc by nd | cc by nd
4 0.75 cc-by-sa | cc by sa | cc by sa
4 0.7 cc-by | cc by | cc by(?! (?:nc|nd|sa)(?: |$))
4 0.7 cc | creative commons | creative commons(?: {L})?
4 0.85 public-domain | public domain | (?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain
5 0.5 public-domain | public domain | public domain
5 0.6 gpl | gpl | (?:{BY}|the |and )(?:gnu )?gpl
5 0.6 lgpl | lgpl | (?:{BY}|the |and )(?:gnu )?lgpl
5 0.6 agpl | agpl | (?:{BY}|the |and )(?:gnu )?agpl
5 0.6 proprietary | proprietary | proprietary and confidential|confidential and proprietary
5 0.6 proprietary | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution|use)
5 0.6 proprietary | commercial use | (?:not for|no) commercial use
5 0.4 no-warranty | without warrant | (?:as is )?without warrant(?:y|ies) of any kind
5 0.5 copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
5 0.6 all-rights-reserved | all rights reserved | all rights reserved
5 0.4 some-rights-reserved | some rights reserved | some rights reserved
"""


@dataclass(frozen=True)
class Rule:
    """Lower priority numbers come first; keyword must be a literal part of every match."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


def signatures(text: str = SIGNATURES) -> list[Rule]:
    """The rules of a table like the one above, stably sorted by priority."""
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        head, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        priority, weight, label = head.split()
        for name, words in MACROS.items():
            pattern = pattern.replace(name, words)
        rules.append(Rule(label, pattern, keyword, int(priority), float(weight)))
    return sorted(rules, key=lambda r: r.priority)

"""License scans by ordered signature rules, in DataFrame expressions only.

A text is lower-cased and reduced to its words with one space between. Keywords
gate the rules: each rule has one without which it can't match, as the beginning
of a word, and only looks at texts with it. A match is an interval of the
reduced text; it is suppressed if an interval of a rule of the same or a higher
priority contains it (equal intervals: higher priority, then the rule's order).
What remains gives the labels and the score.

Three kinds of rules: names of licences (bare, in a grant, in an SPDX tag, in
rising priority), and signatures, which are clauses of licence texts, notices,
"or later" grants, disclaimers and addresses in words.

Cases: null counts as empty text, which has no words and no labels; rows that
repeat give results that repeat; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases of the base scan and their labels (fixed values).
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, SPDX tag in words, keyword, pattern of the name in words (fixed values).
LICENCES = (
    ("mit", "mit", "mit", "mit licen[cs]e"),
    ("x11", "x11", "x11", "x11 licen[cs]e"),
    ("isc", "isc", "isc", "isc licen[cs]e"),
    ("bsd-2-clause", "bsd 2 clause", "bsd", "(?:simplified bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?)"),
    ("bsd-3-clause", "bsd 3 clause", "bsd", "(?:new bsd licen[cs]e|modified bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?)"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", "(?:original bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?)"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("apache-2.0", "apache 2 0", "apache", "apache(?: software)? licen[cs]e(?: version)? v?2 0"),
    ("apache-1.1", "apache 1 1", "apache", "apache(?: software)? licen[cs]e(?: version)? v?1 1"),
    ("apache", "apache", "apache", "apache(?: software)? licen[cs]e"),
    ("gpl-2.0", "gpl 2 0", "general", "gnu general public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("gpl-3.0", "gpl 3 0", "general", "gnu general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("gpl", "gpl", "general", "(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", "gpl", "gnu gpl(?: ?v? ?[123])?"),
    ("lgpl-2.1", "lgpl 2 1", "lesser", "gnu lesser general public licen[cs]e(?: version)? v?2 1"),
    ("lgpl-3.0", "lgpl 3 0", "lesser", "gnu lesser general public licen[cs]e(?: version)? v?3(?: 0)?"),
    ("lgpl", "lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("agpl-3.0", "agpl 3 0", "affero", "(?:gnu )?affero general public licen[cs]e(?: version)?(?: v?3(?: 0)?)?"),
    ("mpl-1.1", "mpl 1 1", "mozilla", "mozilla public licen[cs]e(?: version)? v?1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla", "mozilla public licen[cs]e(?: version)?(?: v?2 0)?"),
    ("epl-1.0", "epl 1 0", "eclipse", "eclipse public licen[cs]e(?: version)? v?1 0"),
    ("epl-2.0", "epl 2 0", "eclipse", "eclipse public licen[cs]e(?: version)?(?: v?2 0)?"),
    ("cddl-1.0", "cddl 1 0", "development", "common development and distribution licen[cs]e(?: version)?(?: v?1 0)?"),
    ("cc-by-4.0", "cc by 4 0", "cc", "cc by 4 0"),
    ("cc-by-3.0", "cc by 3 0", "cc", "cc by 3 0"),
    ("cc-by-sa", "cc by sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "cc by", "cc", "cc by"),
    ("cc-by", "cc by", "creative", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "cc by sa", "creative", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc0-1.0", "cc0 1 0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("public-domain", "public domain", "domain", "public domain"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", "bsl 1 0", "boost", "boost software licen[cs]e(?: version)?(?: v?1 0)?"),
    ("artistic-2.0", "artistic 2 0", "artistic", "artistic licen[cs]e(?: version)?(?: v?2 0)?"),
    ("ofl-1.1", "ofl 1 1", "open", "(?:sil )?open font licen[cs]e(?: version)?(?: v?1 1)?"),
    ("odbl-1.0", "odbl 1 0", "open", "open (?:data commons open )?database licen[cs]e(?: version)?(?: v?1 0)?"),
    ("eupl-1.2", "eupl 1 2", "european", "european union public licen[cs]e(?: version)?(?: v?1 [12])?"),
    ("ms-pl", "ms pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "ms rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("gfdl", "gfdl", "documentation", "gnu free documentation licen[cs]e(?: version)?(?: v?1 [123])?"),
    ("psf-2.0", "psf 2 0", "python", "python software foundation licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl", "openssl licen[cs]e"),
    ("proprietary", "proprietary", "rights", "all rights reserved"),
)

#: Texts and notices: label, what a text must hold, pattern, score (fixed values). Each is a clause of its licence.
SIGNATURES = (
    # grants
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.95),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "this permission notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", 0.9),
    ("mit-0", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 0.95),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?", 0.95),
    ("isc", "the author disclaims all", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.85),
    ("hpnd", "permission to use", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)?", 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.9),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 0.85),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|the|their) contributors may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-3-clause", "endorse or promote", "the names? of (?:[^ ]+ ){1,8}may not be used to endorse or promote products derived from this software", 0.85),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.95),
    ("bsl-1.0", "boost org", "(?:www )?boost org license 1 0 txt", 0.9),
    ("ntp", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies", 0.9),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", 0.95),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("unlicense", "unlicense org", "(?:www )?unlicense org", 0.9),
    ("wtfpl", "what the fuck", "do what the fuck you want to(?: public license)?", 0.9),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0.95),
    ("json", "good not evil", "the software shall be used for good not evil", 0.95),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 0.9),
    ("curl", "permission to use", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.85),
    ("postgresql", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("python", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license", 0.9),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.9),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 0.85),
    # disclaimers and general clauses
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 0.85),
    ("mit", "authors or copyright holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", 0.85),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 0.85),
    ("bsd", "regents and contributors", "this software is provided by the regents and contributors as is and any express or implied warranties", 0.85),
    ("bsd", "possibility of such damage", "even if advised of the possibility of such damage", 0.6),
    ("permissive", "copying and distribution of this file", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 0.9),
    ("permissive", "this file is offered", "this file is offered as is without any warranty", 0.8),
    # apache
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.98),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license", 0.8),
    ("apache-2.0", "apache org licenses", "you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", 0.95),
    ("apache-2.0", "apache org licenses", "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?", 0.9),
    ("apache-2.0", "required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 0.9),
    ("apache-2.0", "more contributor license", "licensed to the apache software foundation asf under one or more contributor license agreements", 0.9),
    ("apache-2.0", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you", 0.9),
    ("apache-2.0", "apache", "apache 2 0 licen[cs]ed?", 0.85),
    ("apache-2.0", "asl", "asl (?:version )?2(?: 0)? licen[cs]e", 0.85),
    ("apache-2.0", "apache", "apache (?:version )?2(?: 0)? licen[cs]e", 0.85),
    # gnu
    ("gpl-1.0-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 1(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("gpl-2.0-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 2(?: 0)?(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("gpl-3.0-or-later", "general public license", "under the terms of the gnu general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("lgpl-2.0-or-later", "library general public", "under the terms of the gnu library general public license as published by the free software foundation either version 2(?: 0)?(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("lgpl-2.1-or-later", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("lgpl-3.0-or-later", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("agpl-3.0-or-later", "affero general public", "under the terms of the gnu affero general public license as published by the free software foundation either version 3(?: 0)?(?: of the license)? or(?: at your option)? any later version", 0.98),
    ("gpl-2.0-or-later", "general public license", "gnu general public license(?: version)? v?2(?: 0)?(?: of the license)? or(?: at your option)? (?:any )?later(?: version)?", 0.95),
    ("gpl-3.0-or-later", "general public license", "gnu general public license(?: version)? v?3(?: 0)?(?: of the license)? or(?: at your option)? (?:any )?later(?: version)?", 0.95),
    ("gpl-2.0-only", "general public license", "under the terms of the gnu general public license version 2(?: 0)?(?: only)? as published by the free software foundation", 0.95),
    ("gpl-2.0-only", "general public license", "version 2(?: 0)? of the gnu general public license(?: only)?", 0.9),
    ("gpl-3.0-only", "general public license", "version 3(?: 0)? of the gnu general public license(?: only)?", 0.9),
    ("gpl-3.0-only", "general public license", "under the terms of the gnu general public license version 3(?: 0)?(?: only)? as published by the free software foundation", 0.95),
    ("lgpl-2.1-only", "lesser general public", "version 2 1 of the gnu lesser general public license(?: only)?", 0.9),
    ("gpl", "free software you can", "this (?:program|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    ("lgpl", "free software you can", "this (?:library|program|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.9),
    ("agpl", "free software you can", "this (?:program|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.9),
    ("gpl", "along with this", "you should have received a copy of the gnu general public license along with this (?:program|file|software|package)", 0.9),
    ("lgpl", "along with this", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|file|software|package)", 0.9),
    ("agpl", "along with this", "you should have received a copy of the gnu affero general public license along with this (?:program|file|software|package)", 0.9),
    ("gpl", "gnu org licenses", "(?:www )?gnu org licenses gpl(?: [123] 0)?(?: html| txt)?", 0.9),
    ("lgpl", "gnu org licenses", "(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", 0.9),
    ("agpl", "gnu org licenses", "(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 0.9),
    ("gpl", "gpl", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? gpl(?: licen[cs]e)?", 0.85),
    ("gpl-2.0", "gpl", "gpl ?v?2(?: 0)?(?: licen[cs]e)?", 0.8),
    ("gpl-3.0", "gpl", "gpl ?v?3(?: 0)?(?: licen[cs]e)?", 0.8),
    ("gpl-2.0-or-later", "gpl", "gpl ?v?2(?: 0)? or(?: any)? later", 0.85),
    ("gpl-3.0-or-later", "gpl", "gpl ?v?3(?: 0)? or(?: any)? later", 0.85),
    ("lgpl", "lgpl", "(?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? (?:gnu )?lgpl(?: licen[cs]e)?", 0.85),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?2 1", 0.85),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?", 0.85),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: version)? ?v?3(?: 0)?", 0.85),
    ("gpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.7),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95),
    ("gcc-exception", "runtime library exception", "gcc runtime library exception(?: version)?(?: 3 1)?", 0.9),
    ("classpath-exception", "classpath", "(?:gpl 2 0 )?(?:with )?classpath exception(?: 2 0)?", 0.9),
    ("copyleft", "copyleft", "copyleft next(?: 0 3 [01])?", 0.8),
    # weak copyleft
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mpl-2.0", "mozilla org mpl", "(?:https? )?(?:www )?mozilla org mpl 2 0", 0.95),
    ("mpl-1.1", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1", 0.98),
    ("mpl-1.1", "mozilla org mpl", "(?:https? )?(?:www )?mozilla org mpl mpl 1 1", 0.95),
    ("epl-2.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0", 0.98),
    ("epl-1.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 0.98),
    ("epl-2.0", "eclipse org legal", "(?:www )?eclipse org legal epl(?: v20| 2 0)", 0.9),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 0.95),
    ("cpl-1.0", "common public license", "common public license(?: version)?(?: v?1 0)?", 0.85),
    ("osl-3.0", "open software license", "(?:licensed under the )?open software license(?: version)? 3 0", 0.9),
    ("afl-3.0", "academic free license", "(?:licensed under the )?academic free license(?: version)?(?: 3 0)?", 0.9),
    ("artistic-2.0", "artistic license", "under the terms of the artistic license(?: 2 0)?", 0.9),
    ("perl", "same terms as perl", "(?:under|with) the same terms as perl(?: 5)?(?: itself)?", 0.9),
    ("ruby", "same terms as ruby", "under the same terms as ruby(?: itself)?", 0.9),
    # creative commons, data and fonts
    ("cc-by-4.0", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by 4 0(?: legalcode| deed)?", 0.95),
    ("cc-by-3.0", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by 3 0(?: legalcode| deed)?", 0.95),
    ("cc-by-2.0", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by 2 [05](?: legalcode| deed)?", 0.95),
    ("cc-by-sa", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by sa(?: [1-4] [05])?", 0.95),
    ("cc-by-nc", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by nc(?: [1-4] [05])?", 0.95),
    ("cc-by-nd", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by nd(?: [1-4] [05])?", 0.95),
    ("cc-by-nc-sa", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [1-4] [05])?", 0.95),
    ("cc-by-nc-nd", "creativecommons org", "(?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [1-4] [05])?", 0.95),
    ("cc0-1.0", "creativecommons org", "(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0", 0.95),
    ("cc-pdm-1.0", "creativecommons org", "(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0", 0.95),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", 0.9),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?", 0.9),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?", 0.9),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?", 0.9),
    ("cc0-1.0", "public domain dedication", "cc0(?: 1 0)?(?: universal)? public domain dedication", 0.95),
    ("cc0-1.0", "copyright and related", "waived all copyright and related or neighboring rights", 0.9),
    ("cc", "creative commons", "(?:licen[cs]ed under|under) a creative commons licen[cs]e", 0.7),
    ("cc", "some rights reserved", "some rights reserved", 0.6),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1", 0.98),
    ("ofl-1.1", "reserved font name", "with reserved font name", 0.9),
    ("odc-by-1.0", "open data commons", "open data commons attribution licen[cs]e(?: v?1 0)?", 0.9),
    ("odbl-1.0", "open data commons", "open data commons open database licen[cs]e(?: odbl)?(?: v?1 0)?", 0.9),
    ("pddl-1.0", "open data commons", "open data commons public domain dedication and licen[cs]e", 0.9),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e v?3 0", 0.9),
    ("ogl", "open government", "open government licen[cs]e", 0.8),
    # public domain and proprietary
    ("public-domain", "public domain", "(?:released|placed|dedicated|put) (?:into|in|to) the public domain", 0.9),
    ("public-domain", "public domain", "this (?:work|file|code|software|text) is in the public domain", 0.9),
    ("proprietary", "all rights reserved", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})? (?:[^ ]+ ){1,8}all rights reserved", 0.7),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.9),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 0.95),
    ("proprietary", "without the prior written", "may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed|transmitted))? (?:[^ ]+ ){0,6}without the prior written (?:permission|consent)", 0.85),
    ("proprietary", "end user licen", "end user licen[cs]e agreement(?: eula)?", 0.8),
    ("commercial", "commercial licen", "(?:a|under a) commercial licen[cs]e(?: is| from)?", 0.7),
    # source available
    ("busl-1.1", "business source licen", "business source licen[cs]e(?: version)?(?: 1 1)?", 0.9),
    ("sspl-1.0", "server side public", "server side public licen[cs]e(?: version)?(?: v?1)?(?: 0)?", 0.9),
    ("elastic-2.0", "elastic licen", "elastic licen[cs]e(?: version)?(?: v?2)?(?: 0)?", 0.85),
    ("polyform", "polyform", "polyform (?:non ?commercial|shield|perimeter|strict|small business|internal use|free trial) licen[cs]e(?: 1 0 0)?", 0.9),
    ("commons-clause", "commons clause", "commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?", 0.85),
    # model licences
    ("openrail", "responsible ai licen", "responsible ai licen[cs]e(?:s)?(?: openrail)?", 0.85),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m| s)?(?: v?1)?", 0.85),
)

#: Phrase around a name ({}), what it must hold beside the name's keyword, priority, score.
GRANTS = (
    ("{}", "", 1, 0.6),
    ("(?:released|available|provided|published|offered) under(?: the)?(?: terms of(?: the)?)? {}", " under ", 2, 0.9),
    ("licen[cs]ed under(?: the)?(?: terms of(?: the)?)? {}", "ed under ", 2, 0.9),
    ("distributed under(?: the)?(?: terms of(?: the)?)? {}", "distributed under ", 2, 0.9),
    ("(?:subject to|covered by|governed by)(?: the)?(?: terms of(?: the)?)? {}", "", 2, 0.85),
    ("(?:this (?:work|program|software|file|library|project|text) is )licen[cs]ed under(?: the)?(?: terms of(?: the)?)? {}", "ed under ", 3, 0.95),
)
#: The SPDX tag, and what may follow it: suffix, label's ending.
_SPDX = (("", ""), (" or later", "-or-later"), (" only", "-only"))


def rules() -> list[tuple[int, int, str, str, str, str, float, bool]]:
    """number, priority, keyword, needs, pattern, label, score, first of its keyword: every licence by every grant phrase and tag, and the signatures."""
    out = []
    for label, tag, keyword, name in LICENCES:
        out += [(priority, keyword, needs, f" {phrase.format(name)} ", label, score) for phrase, needs, priority, score in GRANTS]
        out += [(4, "spdx", f" {tag}{suffix} ", f" spdx licen[cs]e identifier {tag}{suffix} ", label + ending, 1.0) for suffix, ending in _SPDX]
    # a clause is surer than a bare name, a name in a tag surer than a clause
    out += [(3 if score >= 0.8 else 1, keyword, "", f" {pattern} ", label, score) for label, keyword, pattern, score in SIGNATURES]
    seen: set[str] = set()
    rows = []
    for number, (priority, keyword, needs, pattern, label, score) in enumerate(out):
        rows.append((number, priority, keyword, needs, pattern, label, score, keyword not in seen))
        seen.add(keyword)
    return rows


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as an inline table; its size is fixed."""
    values = ", ".join(f"({n}, {p}, '{k}', '{need}', '{r}', '{label}', {s}D, {lead})" for n, p, k, need, r, label, s, lead in rules())
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(rule, priority, keyword, needs, pattern, label, points, lead)")


def reduced(text: Column) -> Column:
    """Lower-cased words with one space between and around; no words: one space."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _places(words: str, phrase: str) -> Column:
    """Numbers of the words where the phrase begins."""
    wanted = phrase.split(" ")

    def here(i: Column) -> Column:
        same = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    spark = docs.sparkSession
    keywords = sorted({r[2] for r in rules()})
    flat = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), reduced(F.col(text)).alias("flat"))
    n_words = (F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) - 1).cast("long")
    base = F.lit(False)
    for phrase, _ in BASE_PHRASES:
        base = base | F.contains("flat", F.lit(f" {phrase} "))
    rows = flat.withColumn("n_words", n_words).withColumn("base", base)
    rows = rows.withColumn("words", F.when(F.col("base"), F.split(F.trim("flat"), " ")))
    for i, (phrase, _) in enumerate(BASE_PHRASES):
        rows = rows.withColumn(f"at_{i}", F.when(F.col("base"), _places("words", phrase)))
    every = F.concat(*(F.coalesce(F.col(f"at_{i}"), F.array().cast("array<int>")) for i in range(len(BASE_PHRASES))))
    labels = F.filter(F.array(*(F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE_PHRASES))), lambda x: x.isNotNull())
    rows = rows.withColumn("every", every).select(
        "key", "doc_id", "flat", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), F.sort_array(labels).alias("base_list")
    )
    found_words = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("flat"), F.concat(F.lit(" "), k)))
    one = ["key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_list"]
    gated = rows.select(*one, "flat", F.posexplode_outer(found_words).alias("at", "keyword"))
    # patterns are compiled for a text only where the words they can't do without are there
    met = gated.join(F.broadcast(rule_table(spark)), "keyword", "left")
    tried = met.withColumn("hits", F.when(F.col("pattern").isNotNull() & F.contains("flat", "needs"), F.expr("regexp_extract_all(flat, pattern, 0)")))
    # a row for each rule that matched, and one for the document whatever matched
    tried = tried.where("size(hits) > 0 or at is null or pattern is null or (at = 0 and lead)")
    # a text between two matches and the match behind it, one after the other: places are running sums of lengths
    between = F.slice(F.split("flat", F.col("pattern"), -1), 1, F.size("hits"))
    pairs = F.when(F.size("hits") > 0, F.zip_with(between, "hits", lambda b, h: F.struct(F.length(b).alias("gap"), F.length(h).alias("len"))))
    one_by_one = tried.select(*one, "rule", "priority", "label", "points", F.posexplode_outer(pairs).alias("nth", "x")).repartition("key")
    along = Window.partitionBy("key", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(along)
    matches = one_by_one.withColumn("end", end).withColumn("start", F.col("end") - F.col("x.len")).drop("x", "nth")
    ahead = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[1] for r in rules()})
    contained = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(ahead)
        contained = contained | ((F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    stays = matches.withColumn("stays", F.col("start").isNotNull() & ~contained)
    per_doc = stays.groupBy(*one).agg(F.collect_set(F.when(F.col("stays"), F.col("label"))).alias("own"), F.max(F.when(F.col("stays"), F.col("points"))).alias("points"))
    score = F.greatest(F.coalesce("points", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0))
    return per_doc.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", "base_list")), ",").alias("labels"), score.alias("score")
    )

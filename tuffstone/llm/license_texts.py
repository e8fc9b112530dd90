"""Public license texts and headers as data: the passages that ``licensing`` looks for.

Every text stands for the license it is listed under. Titles count in license files only, where they tell
which of the long texts follows; wording inside such a text is then no statement of its own.
"""

from __future__ import annotations

_NO_WARRANTY = """
IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_REDISTRIBUTION = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ACKNOWLEDGE = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ANY_PURPOSE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

# Public license texts and headers.
TEXTS = [
    ("MIT", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}"),
    ("MIT-0", f"{_GRANT}. {_MIT_WARRANTY}"),
    ("ISC", f"{_ANY_PURPOSE}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ANY_PURPOSE}. {_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} THIS SOFTWARE {_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} 3. {_NO_NAMES} THIS SOFTWARE {_NO_WARRANTY}"),
    ("BSD-4-Clause", f"{_REDISTRIBUTION} 3. {_ACKNOWLEDGE} the organization. 4. {_NO_NAMES} THIS SOFTWARE {_NO_WARRANTY}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
]
# How the long license texts begin.
TITLES = [
    ("GPL-1.0-only", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0-only", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-1.0", "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Artistic-1.0", 'The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied'),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright"),
    ("GFDL-1.2-only", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3-only", "GNU Free Documentation License Version 1.3, 3 November 2008"),
]


def gnu_headers() -> list[tuple[str, str]]:
    """Headers that put a file under a GNU license, by rule: family, version, with or without later ones."""
    out = []
    for family, name, numbers in (("GPL", "General", ("1", "2", "3")), ("LGPL", "Library General", ("2",)), ("LGPL", "Lesser General", ("2", "2.1", "3")), ("AGPL", "Affero General", ("3",))):
        for number in numbers:
            spdx = f"{family}-{number if '.' in number else number + '.0'}"
            begin = f"you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation"
            out.append((f"{spdx}-or-later", f"{begin}; either version {number} of the License, or (at your option) any later version"))
            out.append((f"{spdx}-only", f"{begin}; version {number} of the License"))
            out.append((f"{spdx}-only", f"you can redistribute it and/or modify it under the terms of version {number} of the GNU {name} Public License as published by the Free Software Foundation"))
    return out


# Ids of the public list beyond those with spellings of their own, and exceptions.
IDS = """
AFL-2.1 AFL-3.0 APSL-2.0 Apache-1.0 Apache-1.1 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 0BSD BSD-1-Clause BSD-3-Clause-Clear BSD-4-Clause
BSD-4-Clause-UC Beerware BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0
CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0
EPL-1.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later HPND ICU IJG IPL-1.0
Libpng libpng-2.0 libtiff LPPL-1.3c MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA NTP ODbL-1.0 OFL-1.0 OFL-1.1
OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SISSL Sleepycat SSPL-1.0
TCL UPL-1.0 Unicode-3.0 Unicode-DFS-2016 Vim W3C WTFPL X11 Xnet ZPL-2.0 ZPL-2.1 blessing bzip2-1.0.6 curl
"""
EXCEPTIONS = """
Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 eCos-exception-2.0 Font-exception-2.0 GCC-exception-2.0
GCC-exception-3.1 Libtool-exception Linux-syscall-note LLVM-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0
"""

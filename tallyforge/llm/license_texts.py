"""Known licence texts and notices. The published wording of the licences."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEXTS = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _MIT_GRANT,
    "ISC": f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_WARRANTY}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_WARRANTY}",
    "Zlib": """zlib License

(C) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
}

#: Digests of both canonical forms of longer texts, as published, whole and, where they have one, without the appendix behind their terms. Fixed values.
DIGESTS = {
    "Apache-2.0": [
        "41681f5eb40fbe9be7bd00ebab042c20555a6600c390f351ffc1573f313db880",
        "b501eac0d67e8e7f085e6e510564d1c152d7412260160e58887e4383c216d570",
        "9542ef8756f73da8800b2d260848376ff7c743ee38f4e6cbdaca5e647bfbce05",
    ],
    "Artistic-1.0-Perl": [
        "363d5cd2c1e5063e9870ebc3faf5b0d15b0e592bbe65f87ede1ff2b873cbd260",
    ],
    "BSD-3-Clause": [
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ],
    "CC0-1.0": [
        "1857a6817be463d903691bfa09d4f345ab7f4ed86a5db2a5966c03b160057e4a",
    ],
    "GFDL-1.2": [
        "ff5488d0c47177f0cb7a46d15641f0dce9bbf70becc88f1a89956bea24a711cc",
        "f5add91faea31f2c7420656dbfbc3e6561c9e4ef52e7046cf670c15db21bc803",
    ],
    "GFDL-1.3": [
        "27208c71021f9a47ed312dff49f4e4210708f1b311050d24c26a69010698b5fb",
        "e1043944511209b6369baa1db8ac9ef998b3b2a899b66326c689fc421872ded7",
    ],
    "GPL-1.0": [
        "d0f657890771d4ceec144666f123f5c4953626733687f28210fd4ed936aab31e",
        "9f6b830495836fe7a90a7b8245b3ebcb7cc99461134d6dd3fcae863d2b3f1d96",
        "2c4b87a2d6aacb3ebfbfc1d3b76b65014eaa17bf1189ff96ff23e2a6bab8b294",
        "3edf3894fcb061b26368a469f84e6a01c43da602892ff5aecfc92523e4ccb323",
    ],
    "GPL-2.0": [
        "88dcbb6d0c22081edfe626e841ced1bdce4499e1b07ef62a84c9367b746a7887",
        "5a27c6e471b802aac62e65e0da6e7044731ec871d061c0102135504fd0d2d158",
        "d86a7ffd46f1f9e6878d556e8c2d3e8b88defabcb2f6fd96bd49c330c34669c4",
        "9ca1ab8b1e3787c9b1beb09cb7561b4eebf6323531c555568c8572a22c8ecbb8",
        "b710286b6f262cbb5797037ec5b45819540f463f68a7cbfaeb7240a4e0f451d9",
        "b0179c1e1a41fa0ff709d1df21169ea63f644ca5afa9ace7ddbf239025045149",
    ],
    "GPL-3.0": [
        "bf8b7e15be39d66b9124797544a97a18d7d44f2db6e737092de7e2fd14d6617d",
        "43f76f0c99efee295845389025cfbdf1b7b26489e7fe33547777fef93f7acfbd",
        "1dbdc83d801eee6e277249509e943903546ef142a79b35d3d52eaf1bd71691fd",
        "b6b8eb4714a3768ed6adcf54c2e330d7edb850c86b6c580bc32d2022c242155a",
        "db246b9f94ec8803b95f3ad9e3e10e18c3bd72746ff20bed34c95dce0afa2f54",
        "04b23b5fb95cfcf6bc334ad1df05c354376e67031a003e431e59399f940c904d",
    ],
    "LGPL-2.0": [
        "b0dbea3b50833a2c042020899d95481bee4e2ce84408fe4b45410c2492d76c62",
        "2c9e3be3491a71b69f9e4244fb01856bfe7e0dd2e33429a139609c2aaaa147b3",
        "104ed6c90af04709019bfb531434cd07c3cacc7576470e021ff14954e2c7b633",
        "485c630c9205caa13ed0c18ebde4f3bdd75ba365f7f1425a705feef0df220c1c",
        "11f4fd685087264e923deaa5eb83e5eb651a41add4b38125455143a8738d926e",
        "a7bfc1c9b58400c74cd15367d59a95dc3316d492c88efc64ba5d060d6504d29f",
    ],
    "LGPL-2.1": [
        "d009717f0891b44e9c32525546b140cad1d53b6bd5c22ad1eee70d399632dc83",
        "cafd7eb36b074c6228c6b82f71c4d2959ced5bdcbe1a289e85b3fe5aee96cf50",
        "9ed5e4772a311db4bd2ae002ef425590414c2733d39831e032dd71023429c5b9",
        "1ceb8f0003a28fe2c24174d8f4b33ff13f302a3c476f88d08cb5b3c8653528d3",
        "cd7efd352799deb7800cee83075330f7df50f84fca44cf2adf7693c1d09b7fb3",
        "b3e0a29a49b6480ef3ac684913706accded6f570f151b7edfca48838d1f1e5f2",
    ],
    "LGPL-3.0": [
        "53c5e01d80c5d86ef0f0eb38d2c2933e31aee6b5e6898b8b60dcd7c9d897ca4d",
        "7d846aee4ae5357bd10f2c09607f85c0ed3e9c3c52279f238ad24458a6870932",
    ],
    "MPL-1.1": [
        "aa4def9ce7fe08f33849199cb84494fb8af615d543f9870d724914c21ddc750c",
    ],
    "MPL-2.0": [
        "79a1062834a9713f3b7e26a39cb2001dbca2cee554cdb67b3146b3c799282639",
    ],
}

#: Short notices that stand for a licence.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}

#: Equivalent spellings, after case and punctuation are folded.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "modelling": "modeling",
    "non infringement": "noninfringement", "non commercial": "noncommercial", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "copyright owner": "copyright holder", "sub license": "sublicense", "sub licence": "sublicense", "version": "v", "https": "http",
}

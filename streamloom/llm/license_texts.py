"""Notices by licence family, and texts that only sound like them."""

# Sentences of the public licence texts and their usual notices.
TEMPLATES = {
    "mit": [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "This project is available under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

OTHER = [
    "He renewed his driving license last week and paid the fee at the office.",
    "The version of the story that was released in the public library is free to read.",
    "All terms and conditions of the sale apply to this order.",
    "The software was modified to run on any machine without a warranty from the maker.",
    "Students at MIT and other schools have published a work on the subject.",
    "The Apache helicopter was distributed to units under the command.",
    "A gnu is a large animal that lives on the plains in Africa.",
    "See the file in the root of the project for more information.",
    "The general public was in the hope that the work would be useful.",
    "The source of the river is in the hills and its form changes each year.",
    "Attribution of the painting is not certain, except where the author has signed it.",
    "A fishing license is required by law in this state.",
    "The foundation gives free copies of the book to any person who asks.",
    "Use of the hall is permitted on the following days.",
    "The court held that the copyright in the song had expired.",
    "Version 2.0 of the program was released on Monday with many changes.",
    "Common land was used by all and creative ways were found to share it.",
    "Permission to build was granted by the council in writing.",
    "Licensed under the Eclipse Public License 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "Released under the zlib License.",
    "This software is provided as-is, without any express or implied warranty; in no event will the authors be held liable.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License.",
    "All rights reserved. No part of this work may be copied without written permission.",
    "Proprietary license: use of this software is subject to the terms of the agreement with the vendor.",
    "Licensed under the Python Software Foundation License Version 2.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the PHP License, version 3.01.",
    "Published under the Open Government Licence v3.0.",
]

#: Lines of no family in TEMPLATES that aren't trained on: the threshold is set on them.
UNSEEN = [
    "Licensed under the EUPL, Version 1.2 or later.",
    "Licensed under the European Union Public License, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: CDDL-1.0",
    "Released under the Common Development and Distribution License, version 1.0.",
    "This file is licensed under the Microsoft Public License.",
    "Licensed under the Academic Free License version 3.0.",
    "This software is licensed to you, not sold; you may not copy, modify or distribute it.",
    "Contact the sales office for a commercial license and its terms.",
    "The driving license office will not accept copies of the form.",
    "A copy of the report is included in all editions of the work.",
    "This programme is shown free of charge in the hope that all will see it.",
    "The source of the quotation is not known and its form varies.",
    "Version 3 of the plan was published by the general assembly.",
    "Redistribution of land was one of the conditions of the treaty.",
    "The notice must be kept in the entrance of the building.",
    "You should have received a letter along with this parcel.",
]

# Usual ways to name a licence.
PATTERNS = (
    "{}",
    "License: {}",
    "Released under the {}.",
    "Licensed under the {}.",
    "This work is licensed under the {}.",
    "This project is available under the terms of the {}.",
    "Distributed under the {}. See the LICENSE file for details.",
    "Use of this code is governed by the {}.",
    "SPDX-License-Identifier: {}",
)
NAMES = {
    "mit": ["MIT License", "MIT license (MIT)", "MIT"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License 2.0", "Apache-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL version 2 or later", "GPL, version 3", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 3", "LGPL, version 2.1", "LGPL-3.0-or-later"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL, version 3", "AGPL-3.0-or-later"],
    "bsd": ["BSD 3-Clause License", "New BSD license", "2-clause BSD license", "BSD-2-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0", "Mozilla Public License 1.1", "MPL-1.1"],
    "cc": ["Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0 license", "CC BY-NC 4.0", "Creative Commons Attribution-ShareAlike 3.0 license", "CC-BY-SA-4.0"],
    "public_domain": ["Unlicense", "CC0 1.0 Universal public domain dedication", "CC0 public domain dedication", "CC0-1.0"],
}
OTHER_NAMES = [
    "Eclipse Public License 2.0",
    "European Union Public License, version 1.2",
    "zlib License",
    "Artistic License 2.0",
    "Boost Software License, Version 1.0",
    "Common Development and Distribution License, version 1.0",
    "Microsoft Public License",
    "Python Software Foundation License Version 2",
    "PHP License, version 3.01",
    "Academic Free License version 3.0",
    "Open Government Licence v3.0",
    "agreement with the vendor",
    "SIL Open Font License, Version 1.1",
    "IBM Public License Version 1.0",
    "Sun Public License v1.0",
    "University of Illinois/NCSA Open Source License",
    "EPL-2.0",
    "Zlib",
    "EUPL-1.2",
    "BSL-1.0",
    "CDDL-1.0",
]

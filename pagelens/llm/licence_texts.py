"""Short public licence notices by family, and sentences of none."""

NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is distributed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Released under the MIT licence.",
        "The MIT License",
        "MIT licence",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "Distributed under the terms of the Apache Software License 2.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 3.",
        "Released under the GPL v3 license.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL license.",
        "Released under the GNU LGPL version 3.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL license.",
        "Released under the GNU AGPL version 3.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the MPL 2.0 license.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the CC BY-NC license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Released under the CC BY-SA license.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the CC BY license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights: CC0 public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Released under the CC BY-NC-ND license.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Released under the CC BY-NC-SA license.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Released under the CC BY-ND license.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "made available under the terms of the Eclipse Public License 2.0",
        "Released under the EPL 2.0 license.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        "you can redistribute it under the terms of the Artistic License (2.0)",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "SSPL": [
        "Licensed under the Server Side Public License, version 1.",
        "Released under the SSPL license.",
        "SPDX-License-Identifier: SSPL-1.0",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain by the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# How the families are called: in the texts that the model is calibrated on, and
# as the shortest templates that confirm a family.
CALLED = {
    "MIT": ["MIT License", "MIT licence"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"],
    "GPL": ["GNU General Public License", "GNU GPL version 3", "GPLv3 license, the GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "BSD": ["BSD License", "BSD 2-Clause License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0 license"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International", "CC BY 4.0"],
    "CC0": ["CC0 1.0 Universal"],
    "ISC": ["ISC License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND": ["CC BY-ND 4.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "SSPL": ["Server Side Public License version 1"],
    "Unlicense": ["terms of the Unlicense", "the Unlicense"],
}
SAID = [
    "The code is available under the {}.",
    "This file is covered by the {} as stated below",
    "All parts are licensed under the {}",
]

OTHER = [
    "He lost his driving license last summer.",
    "The licence fee was raised again this year.",
    "A fishing license is required in the park.",
    "Copyright law protects authors.",
    "Copyright 2019, all rights reserved.",
    "All rights reserved; no part may be copied without written permission.",
    "The warranty covers parts for two years.",
    "There is no warranty on used cars.",
    "She asked for permission to leave early.",
    "With the permission of the owner we entered the house.",
    "The tax would redistribute income to the poor.",
    "The redistribution of land began in spring.",
    "The Apache helicopter landed near the village.",
    "The Apache people live in the southwest.",
    "Mozilla is a company that makes a browser.",
    "The gnu is a large antelope of the plains.",
    "Creative work needs time and quiet.",
    "The House of Commons met on Tuesday.",
    "Please send it to me and cc my colleague.",
    "The engine has a volume of 500 cc.",
    "The doctor was licensed to practise in two states.",
    "The bar is licensed until midnight.",
    "An eclipse of the sun was seen at noon.",
    "The license plate was made of steel.",
    "Their business model is to license patents to others.",
    "The software costs nothing for schools.",
    "The artistic director spoke about permission to perform.",
    "The server side of the licence office was closed.",
    "A boost to software sales came from a new license fee.",
    "The public domain is explained in the copyright act.",
]

# Sentences of none that training does not see.
HELD_OTHER = [
    "Her driving licence was renewed under the new law.",
    "Permission is required to enter the garden.",
    "The copyright of the song is held by the band.",
    "Apache is the name of a web server and of a people.",
    "There is no warranty that the bridge will hold.",
    "The council will redistribute the money next year.",
    "Creative people met on the commons.",
    "He was licensed under the old rules of the harbour.",
    "The licence number is printed on the back.",
    "They are licensed to sell wine in the village.",
    "Send a copy to the clerk, cc the mayor.",
]

# Words at least one of which is in every feature; other words carry no weight.
ANCHORS = (
    "license licence licensed licenced licenses licenses copyright gnu gpl lgpl agpl "
    "apache bsd mpl mozilla spdx warranty warranties redistribute redistribution "
    "redistributions permission creative commons cc cc0 isc affero epl bsl sspl unlicense "
    "artistic eclipse unencumbered"
).split()
